"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets are one class from the start. A class posts itself under its (coordinate, value)
pairs. Two classes of similarity s agree on about s of the K coordinates, and on fewer than `least` only with
probability MISS. Of pairs that agree on `least` of K tokens, both have a common token among their K - least + 1 rarest,
so only those are posted (prefix filter); tokens that no other class has come first in that order and need no posting.
The other collisions are skipped: they are counted from the two signatures of a pair that met. Pairs that collide often
enough are confirmed on their full sets.

What a class shares with no other posted class can't be in an intersection, so the number of its shingles that others
have too bounds each of its similarities exactly; classes whose bound is too low are dropped before they meet.

Linked classes have sizes of a ratio of the similarity at least. So a list is cut into overlapping bands of sizes, each a
list of its own: of classes in one of the steps of that ratio and in the next one.

A posting list of more than SHORT members is not expanded into its pairs. A few of its members, the same ones for all the
lists of a group of copies, vote for a core P: the shingles that more than half of them have. Against it a member x has
some shingles missing (d of them) and some added. With o(x, y) the least intersection that links x and y,

    |x & y| = |P| - d(x) - d(y) + shared missing ones + shared added ones.

Groups of WITHIN shingles at most are settled in one task each (`united`), with the majority of all members as the core. By
that equation it needs no sets but differences: a member is tested against those of other components that share enough
of its missing and added shingles, by the prefix filter; what only one component has is left out again and again, and
members of the largest component ask nothing, as others ask them. That finds all links between components.

Larger groups go through rounds over the whole cluster. Either |P| - d(x) - d(y) >= o(x, y), and x and y are linked, or
they are linked only if they share a missing or added shingle. Of the first kind of pairs, all that have one are linked with the member of the least d + o's share of it; all
members are tested against that one, by the equation and so on full sets, and linked members are united. For the second
kind, a shared added shingle weighs 100 and a missing one `percent`: x needs partners of which it shares the weight

    (100 + percent) * d(x) + percent * |x| - 100 * |P|,

since what is shared counts in y's measure too. Members of lists that still hold several components count, of their
missing and added shingles, those that another component has as well. Where these weigh too little, x has no partner
left; the others post themselves again under the rarest ones, until what is left weighs too little (the prefix filter
again, by counts over the whole group). The new lists are handled likewise, until none holds several components. None of
them has more than half of the voters of what it comes from, so this ends. Short lists are tested a round later, between
components only, as the long ones unite most of their members. Each filter is exact for any core and no link is lost by
them. A group of n copies with edits of their own, near each other or not near enough, costs some tests a member over the
cluster. Within a task, members that share differences with many others and are linked with none of them are tested
against all these, which WITHIN bounds.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text of
fewer words than a shingle has is one shingle; a null doc_id takes no part, has no component and is kept; of rows with
one doc_id each is returned with the component of its own text, named by its smallest doc_id; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.llm import text as T
from voxelframe.llm.components import components, few, keep, partitions
from voxelframe.llm.rendezvous import Rendezvous, merge
from voxelframe.session import ship, table

COORDINATES, MISS = 64, 1e-7
#: A list of so many members is tested pair by pair; in longer ones so many vote for a core.
SHORT, VOTERS = 12, 15
#: Shingles of the sets of a group of lists that one task settles (16 MB of hashes).
WITHIN = 2 << 20
_RNG = np.random.Generator(np.random.PCG64(77))
FACTOR = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
TERM = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def least_matches(similarity: float, n: int = COORDINATES, miss: float = MISS) -> int:
    """The greatest number of matches that pairs of this similarity fall short of with probability `miss` at most."""
    below, t = 0.0, 0
    while True:
        below += comb(n, t) * similarity**t * (1 - similarity) ** (n - t)
        if below > miss:
            return t
        t += 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes in order of row and hash, and the number of each row's."""
    low = T.LOWER[buf]
    start, end, row = T.spans(low, off)
    h = T.span_hash(T.prefix(low), start, end, low)
    n = np.bincount(row, minlength=len(off) - 1)
    whole = T.windows(h, k)
    at = np.flatnonzero(row[: len(whole)] == row[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    keys, rows = [whole[at]], [row[at]]
    first = np.cumsum(n) - n
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            acc = h[first[short]]
            for j in range(1, size):
                acc = acc * T.FOLD + h[first[short] + j]
            keys.append(T.mix(acc + np.uint64(size)))
            rows.append(short)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[once], np.bincount(rows[once], minlength=len(off) - 1)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size of the shingle set, a 128-bit digest of it as one and two, and the signature (32 bits a
    coordinate)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
                keys, n = shingle_sets(buf, off, k)
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                signature = np.zeros((j - i, COORDINATES), np.uint32)
                digest = np.zeros((2, j - i), np.uint64)
                if len(some):
                    for c in range(COORDINATES):
                        signature[some, c] = np.minimum.reduceat(((keys * FACTOR[c] + TERM[c]) >> np.uint64(32)).astype(np.uint32), first)
                    digest[0, some] = np.add.reduceat(T.mix(keys), first)
                    digest[1, some] = np.add.reduceat(T.mix(keys ^ TERM[0]), first)
                raw = signature.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(i, j - i), "n": n, "one": digest[0].view(np.int64), "two": digest[1].view(np.int64),
                    "signature": [raw[4 * COORDINATES * r : 4 * COORDINATES * (r + 1)] for r in range(j - i)],
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, one long, two long, signature binary")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(doc_id, n, tokens): each class that has enough shared tokens, with the rarest of these (as structs of count and
    token), as many as the prefix filter needs."""

    def tokens(batches):
        salt = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None, :]
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
            token = T.mix(sig.astype(np.uint64) + salt).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_pydict({"token": token, "doc_id": np.repeat(np.asarray(batch.column("doc_id")), COORDINATES), "n": np.repeat(np.asarray(batch.column("n")), COORDINATES)})

    every = classes.select("doc_id", "n", "signature").mapInArrow(tokens, "token long, doc_id long, n long")
    shared = every.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    own = every.join(shared, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("many", "token"))).alias("tokens"))
    rarest = F.slice("tokens", 1, F.size("tokens") - (least - 1))
    return own.where(F.size("tokens") >= least).select("doc_id", "n", rarest.alias("tokens"))


def shared_sets(cand: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles): the size of the set of each of the candidates (doc_id, text), and those of its shingles that
    another candidate has too, the rarest first (by powers of 2**0.25, then by hash: an order that all sets share)."""
    r = Rendezvous(cand)

    def sets(docs):
        docs = T.rows_in_order(docs)
        parts = [shingle_sets(buf, off, k) for _, _, buf, off in T.chunks(*T.flat(docs["text"]))]
        return docs["doc_id"], T.joined([x for x, _ in parts], np.uint64), T.joined([n for _, n in parts], np.int64)

    def ask(docs, _):
        keys, n = np.unique(sets(docs)[1], return_counts=True)
        return keys, n.astype(np.uint32)

    def answer(_, asked):
        groups, ends, index, (n, keys) = merge(asked)
        rank = np.minimum(255, np.ceil(4 * np.log2(np.bincount(index, n, len(keys))))).astype(np.uint8)
        for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True):
            yield g, rank[index[a:b]].tobytes()

    def finish(docs, answers):
        ids, every, n = sets(docs)
        _, index = np.unique(every, return_inverse=True)
        rank = np.frombuffer(b"".join(answers.values()), np.uint8)[index.reshape(-1)]
        many = rank > 0
        row = np.repeat(np.arange(len(n)), n)[many]
        own = every[many][np.lexsort((every[many], rank[many], row))]
        cut, raw = (8 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])).tolist(), own.tobytes()
        return pa.table({"id": ids.cast(pa.int64()), "n": n, "shingles": pa.array([raw[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return r.finish(finish, r.answer(r.ask(ask), answer), "id long, n long, shingles binary")


def beside(pairs: DataFrame, rows: DataFrame, **names: str) -> DataFrame:
    """`pairs` (a, b), a written table, with the columns of `rows` (id, ..) of a, then of b, under the two new names given for each. Rows of b
    that no pair has are left out before they are shuffled."""
    second = pairs.select(F.col("b").alias("id"))
    pairs, second = few(pairs), few(second)
    for side, at in (("a", 0), ("b", 1)):
        own = rows.join(second, "id", "left_semi") if at else rows
        pairs = pairs.join(own.select(F.col("id").alias(side), *[F.col(c).alias(both.split()[at]) for c, both in names.items()]), side)
    return pairs


def collided(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Those of `pairs` (a, b) whose signatures collide often enough."""

    def collide(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("x", "y"))
            yield batch.filter(pa.array((x == y).sum(1) >= least)).select(["a", "b"])

    return beside(pairs, signatures, signature="x y").mapInArrow(collide, "a long, b long")


def linked(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that are similar by their full sets."""

    def similar(batches):
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(linked(n, m, common, percent))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return beside(pairs, sets, n="n m", shingles="x y").mapInArrow(similar, "a long, b long")


def core(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles that more than half of the sets have."""
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    return keys[2 * n > len(sets)]


def differences(members: DataFrame, cores: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, core, id, n, size, far, adds, keys): for `members` (band, core, id), the core's size; 100 + percent times what
    is missing of the core plus percent times n, so that two are surely linked if theirs add up to 100 + percent times the
    core's size at most; and keys of the added shingles (so many as adds says) and then of the missing ones."""

    def differ(batches):
        for batch in batches:
            size, far, adds, keys = [], [], [], []
            for c, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("core", "n", "shingles", "whole")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, missing = x[np.isin(x, y, assume_unique=True, invert=True)], y[np.isin(y, x, assume_unique=True, invert=True)]
                salt = np.array([c], np.int64).view(np.uint64)
                size.append(len(y))
                far.append(percent * n + (100 + percent) * len(missing))
                adds.append(len(added))
                keys.append(np.concatenate([T.mix(added ^ T.mix(salt)), T.mix(missing ^ T.mix(~salt))]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("band", "core", "id", "n")), *(pa.array(v, pa.int64()) for v in (size, far, adds)), pa.array(keys, pa.list_(pa.int64()))],
                ["band", "core", "id", "n", "size", "far", "adds", "keys"],
            )

    both = sets.join(few(members), "id").join(few(cores), "core").select("band", "core", "id", "n", "shingles", "whole")
    return both.mapInArrow(differ, "band int, core long, id long, n long, size long, far long, adds long, keys array<long>")


def beside_nearest(made: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of linked members of `made`: each with the one nearest to the core, by their differences."""

    def similar(batches):
        for batch in batches:
            good = []
            for size, n, m, i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("size", "n", "m", "adds", "adds2", "keys", "keys2")), strict=True):
                same = len(np.intersect1d(np.array(x, np.int64), np.array(y, np.int64), assume_unique=True))
                good.append(linked(n, m, size - (len(x) - i) - (len(y) - j) + same, percent))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    own = made.select("band", "core", "id", "far").repartition(partitions(made), "band", "core")
    nearest = keep(own.groupBy("band", "core").agg(F.min_by("id", F.struct("far", "id")).alias("id")), "nearest")
    other = made.join(few(nearest), ["band", "core", "id"]).select("band", "core", F.col("id").alias("b"), F.col("n").alias("m"), F.col("adds").alias("adds2"), F.col("keys").alias("keys2"))
    both = made.withColumnRenamed("id", "a").join(few(keep(other, "nearest")), ["band", "core"]).where("a <> b")
    return both.select("a", "b", "size", "n", "m", "adds", "adds2", "keys", "keys2").mapInArrow(similar, "a long, b long")


def reposted(made: DataFrame, percent: int, n: int) -> DataFrame:
    """(key, band, id, n): the keys under which members of `made` (with their component, own) have to meet those of other
    components. Rows are dealt into n partitions."""

    def prefix(batches):
        for batch in batches:
            out = []
            for need, keys in zip(batch.column("need").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                weight = np.array([k["weight"] for k in keys], np.int64)
                rest = np.cumsum(weight[::-1])[::-1]  # of this key and all after it
                out.append([k["key"] for k, r in zip(keys, rest.tolist(), strict=True) if r >= need])
            yield pa.RecordBatch.from_arrays([batch.column("band"), batch.column("id"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], ["band", "id", "n", "keys"])

    need = F.greatest(F.lit(1), F.col("far") - 100 * F.col("size")).alias("need")
    rows = made.select("band", "core", "id", "n", need, "own", "adds", F.posexplode("keys").alias("pos", "key"))
    rows = rows.select("band", "core", "id", "n", "need", "own", "key", F.when(F.col("pos") < F.col("adds"), 100).otherwise(percent).alias("weight")).repartition(n, "band", "key")
    shared = rows.groupBy("band", "key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    found = rows.join(shared.select("band", "key", "many"), ["band", "key"]).repartition(n, "band", "core", "id").groupBy("band", "core", "id", "n", "need")
    found = found.agg(F.sum("weight").alias("whole"), F.array_sort(F.collect_list(F.struct("many", "key", "weight"))).alias("keys")).where("whole >= need")
    return found.mapInArrow(prefix, "band int, id long, n long, keys array<long>").select(F.explode("keys").alias("key"), "band", "id", "n")


def united(n: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of the sets (of n shingles, these being all that others may have) the number of one that stands for its component."""
    m, each = len(sets), 100 + percent
    keys, key = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    common = 2 * np.bincount(key, minlength=len(keys)) > m
    size = int(common.sum())
    own = common[key]
    inside = np.zeros((m, size), bool)
    inside[row[own], (np.cumsum(common) - 1)[key[own]]] = True
    far = percent * n + each * (size - inside.sum(1))
    # x and y are linked if they share so many differences: (far(x) + far(y)) / each - size.
    lost_row, lost = np.nonzero(~inside)
    row, key = np.concatenate([row[~own], lost_row]), np.concatenate([key[~own], len(keys) + lost])
    del inside, lost_row, lost, own
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    label, asked = np.arange(m), np.zeros(m, bool)
    label[far + far.min() <= each * size] = np.argmin(far)
    need = np.maximum(1, -((each * size - far - far.min()) // each))
    while True:
        # What one component alone has makes no link to others, and members that have asked have met all.
        left = ~asked[row]
        row, key = row[left], key[left]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(start):
            return label
        many, of = np.diff(start, append=len(key)), label[row]
        several = np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start)
        left = np.repeat(several, many)
        row, many = row[left], many[several]
        key = np.repeat(np.arange(len(many)), many)
        start, has = np.cumsum(many) - many, np.bincount(row, minlength=m)
        own, first = key[np.argsort(row, kind="stable")], np.cumsum(has) - has
        mark = np.zeros(len(many), bool)
        ask = np.flatnonzero(~asked & (has >= need) & (label != np.argmax(np.bincount(label))))
        if not len(ask):
            return label
        moved = 0
        for x in ask[np.argsort(far[ask], kind="stable")].tolist():
            asked[x] = True
            mine = own[first[x] : first[x] + has[x]]
            rare = mine[np.argsort(many[mine], kind="stable")][: len(mine) - need[x] + 1]
            others = np.unique(row[T.take_ranges(start[rare], many[rare])])
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            mark[mine] = True
            same = np.add.reduceat(mark[own[T.take_ranges(first[others], has[others])]], np.cumsum(has[others]) - has[others], dtype=np.int64)
            mark[mine] = False
            partners = others[each * (size + same) >= far[x] + far[others]]
            if len(partners):
                gone = np.unique(label[partners])
                label[np.isin(label, gone)] = label[x]
                moved += len(gone)
                if 8 * moved >= len(ask):
                    break


def settled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold the components of each of the groups of `members` (band, core, id) together, a task for each group."""

    def run(group):
        label = united(np.asarray(group["n"]), [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], percent)
        a = np.flatnonzero(label != np.arange(len(label)))
        ids = np.asarray(group["id"])
        return pa.table({"a": ids[a], "b": ids[label[a]]})

    both = sets.join(few(members), "id").select("band", "core", "id", "n", "shingles")
    return both.groupBy("band", "core").applyInArrow(run, "a long, b long")


def voted(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(core, whole): the cores by the voters of `lists` (core, voters)."""

    def vote(batches):
        for batch in batches:
            out = [core([np.frombuffer(x, np.uint64) for x in own]).tobytes() for own in batch.column("sets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("core"), pa.array(out, pa.binary())], ["core", "whole"])

    voters = lists.select("core", "voters").dropDuplicates(["core"]).select("core", F.explode("voters").alias("id"))
    own = voters.where("id IS NOT NULL").join(sets.select("id", "shingles"), "id").groupBy("core").agg(F.collect_list("shingles").alias("sets"))  # at most VOTERS
    return own.mapInArrow(vote, "core long, whole binary")


def _digested(batches, k: int):
    for batch in batches:
        for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text"), pa.array(digest_of(*shingle_sets(buf, off, k)))], ["doc_id", "text", "one"])


def digest_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(T.mix(keys), (np.cumsum(n) - n)[some])
    return out.view(np.int64)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, within: int = WITHIN) -> DataFrame:
    """A row for each of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept. Documents are linked if 100
    times their sets' intersection is at least `percent` times their union. Groups of at most `within` shingles are
    settled in one task each."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = least_matches(percent / 100)
    every = keep(sketches(docs, k), "sketches")
    some = every.where("doc_id IS NOT NULL AND n > 0")
    # All with an equal set are one class; its text is that of the smallest doc_id, which other classes may share. From
    # here to the components a class goes by its id, also where the column is named doc_id.
    classes = keep(some.groupBy("one", "two", "n").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()), "classes")
    single = classes.select(F.col("id").alias("doc_id"), "n", "signature")
    posted = keep(postings(single, least), "postings")
    home = keep(posted.select(F.col("doc_id").alias("id")).join(classes.select("id", "doc_id", "one"), "id"), "homes")
    cand = docs.select("doc_id", "text").join(few(home.select("doc_id")), "doc_id", "left_semi").mapInArrow(lambda batches: _digested(batches, k), "doc_id long, text string, one long")
    cand = keep(cand.join(home, ["doc_id", "one"]).dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "text"), "candidates")
    sets = keep(shared_sets(cand, k).where(100 * F.length("shingles") / 8 >= percent * F.col("n")), "sets")
    signatures = keep(single.withColumnRenamed("doc_id", "id").select("id", "signature").join(sets.select("id"), "id"), "signatures")
    step = F.floor(F.log("n") / (1.000001 * log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    lists = posted.select(F.col("doc_id").alias("id"), F.explode("tokens.token").alias("key")).join(sets.select("id", "n", F.explode(F.array(step, step - 1)).alias("band")), "id")
    links, label = None, None

    def label_of(rows: DataFrame, column: str, name: str) -> DataFrame:
        if label is None:
            return rows.withColumn(name, F.col(column))
        found = label.select(F.col("node").alias(column), F.col("component").alias(name))
        return rows.join(few(found), column, "left").withColumn(name, F.coalesce(name, F.col(column)))

    whose, member = ["key", "band"], ["key", "band", "id", "n"]
    part = F.pmod(F.xxhash64("id"), F.lit(VOTERS))

    voting = [F.min(F.when(part == v, F.col("id"))).alias(f"v{v}") for v in range(VOTERS)]
    voters = F.array(*[F.col(f"v{v}") for v in range(VOTERS)]).alias("voters")

    def unfinished(lists: DataFrame, n: int) -> DataFrame:
        """Members, with their components, and sizes of the lists that hold several components, dealt into n partitions."""
        own, all_of = label_of(lists.select(*member), "id", "own").repartition(n, *whose), Window.partitionBy(*whose)
        own = own.select("*", F.min("own").over(all_of).alias("lo"), F.max("own").over(all_of).alias("hi"), F.count("*").over(all_of).alias("many"))
        return own.where("lo < hi").select(*member, "own", "many")

    def grouped(long: DataFrame) -> DataFrame:
        """Which core each list has. At first that is one for all lists of a group of copies: the lists whose members meet
        the same least id in their lists. Later on, when lists are parts of groups, those of the same voters share it."""
        if label is not None:
            return long.groupBy(*whose).agg(*voting).select(*whose, F.xxhash64(voters).alias("core"))
        least = F.min("id").over(Window.partitionBy(*whose)).alias("least")
        met = long.select(*whose, "id", least).withColumn("least", F.min("least").over(Window.partitionBy("band", "id")))
        return met.groupBy(*whose).agg(F.xxhash64("band", F.min("least")).alias("core"))

    due, n = None, partitions(posted)
    while lists is not None or due is not None:
        found, made, long = [], None, None
        if due is not None:
            # At most SHORT members, so less than SHORT pairs for each.
            ids = F.array_sort(F.collect_list(F.struct("id", "own"))).alias("ids")
            short = unfinished(due, due_n).groupBy(*whose).agg(ids).select("ids", F.explode("ids").alias("x"))
            others = F.filter("ids", lambda y: (y["id"] > F.col("x.id")) & (y["own"] != F.col("x.own")))
            pairs = short.select(F.col("x.id").alias("a"), F.explode(others["id"]).alias("b"))
            pairs = keep(pairs.repartition(due_n, "a", "b").distinct(), "pairs")
            if not pairs.isEmpty():
                found.append(confirmed(keep(collided(pairs, signatures, least), "collided"), sets, percent))
            due = None
        if lists is not None:
            lists = keep(unfinished(lists, n), "lists")
            n = partitions(lists)
            if not lists.isEmpty():
                due, due_n = lists.where(F.col("many") <= SHORT), n
                long = lists.where(F.col("many") > SHORT)
                long = None if long.isEmpty() else long
        if long is not None:
            heads = keep(grouped(long.repartition(n, *whose)), "heads")
            long = long.join(few(heads), whose)
            # Written, so that their sizes are known and, where small, they go to the sets instead of these being shuffled.
            members = keep(long.select("band", "core", "id", "n").repartition(n, "band", "core", "id").distinct(), "members")
            crowds = keep(members.groupBy("band", "core").agg(F.sum("n").alias("whole")).where(F.col("whole") > within).select("band", "core"), "crowds")
            crowded = not crowds.isEmpty()
            rest = keep(members.join(few(crowds), ["band", "core"], "left_anti"), "members") if crowded else members
            found.append(settled(rest.select("band", "core", "id"), sets.select("id", "n", "shingles"), percent))
            if crowded:
                long, members = (x.join(few(crowds), ["band", "core"], "left_semi") for x in (long, members.select("band", "core", "id")))
                cores = keep(voted(long.groupBy("core").agg(*voting).select("core", voters), sets), "cores")
                made = keep(differences(keep(members, "members"), cores, sets.select("id", "n", "shingles"), percent), "differences")
                found.append(beside_nearest(made, percent))
        if found:
            new = keep(reduce(DataFrame.unionByName, found), "links")
            links = new if links is None else links.unionByName(new)
            label = components(links) if label is None or not new.isEmpty() else label
        lists = None
        if made is not None:
            open_ = unfinished(long, n).join(few(heads), whose).select("band", "core", "id", "own").repartition(n, "band", "core", "id").distinct()
            n = partitions(made)
            lists = reposted(made.join(few(keep(open_, "open")), ["band", "core", "id"]), percent, n)
    if label is None:
        label = components(every.select(F.lit(0).alias("a"), F.lit(0).alias("b")).limit(0))
    whole = label_of(classes.select("one", "two", "n", "doc_id", "id"), "id", "of")
    least_of = label.join(classes.select(F.col("id").alias("node"), "doc_id"), "node").groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("least"))
    rep = whole.join(least_of, "of", "left").select("one", "two", F.col("n").alias("size"), F.coalesce("least", "doc_id").alias("component_id"))
    joined = every.join(rep, (every.one == rep.one) & (every.two == rep.two) & (every.n == rep["size"]) & every.doc_id.isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
