"""Single objects of any store that Spark's file systems reach: places, listing, ranged reads and credentials."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def uri_to_path(uri: str) -> str:
    """The path of a file URI; a plain path stays as it is."""
    if not uri.startswith("file:"):
        return uri
    if not uri.startswith("file:///"):
        raise ValueError(f"{uri} names a host; file URIs begin with file:///")
    return uri.removeprefix("file://")


@dataclass(frozen=True)
class Place:
    """scheme://bucket/prefix*postfix; without a wildcard the prefix is the whole key."""

    scheme: str
    bucket: str
    prefix: str
    postfix: str | None

    @classmethod
    def parse(cls, uri: str) -> Place:
        at = urlparse(uri, allow_fragments=False)
        key = (at.path + (f"?{at.query}" if at.query else "")).lstrip("/" if at.netloc else "")
        if key.count("*") > 1:
            raise ValueError(f"{uri} has more than one wildcard")
        prefix, star, postfix = key.partition("*")
        return cls(at.scheme, at.netloc, prefix, postfix if star else None)

    @property
    def uri(self) -> str:
        key = self.prefix + ("" if self.postfix is None else "*" + self.postfix)
        return f"{self.scheme}://{self.bucket}/{key}" if self.bucket else f"{self.scheme}://{key}" if self.scheme else key


def credentials(spark: SparkSession, access: str | None = None, secret: str | None = None, token: str | None = None, scheme: str = "s3a", keyfile: str | None = None) -> None:
    """Set what the connectors of an object store take: keys for S3 or, without any, anonymous access; a key file for GCS."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if scheme in ("s3", "s3n", "s3a"):
        if (access is None) != (secret is None):
            raise ValueError("an access key and a secret go together")
        kind = "AnonymousAWSCredentialsProvider" if access is None else "TemporaryAWSCredentialsProvider" if token else "SimpleAWSCredentialsProvider"
        conf.set("fs.s3a.aws.credentials.provider", f"org.apache.hadoop.fs.s3a.{kind}")
        for name, value in (("access.key", access), ("secret.key", secret), ("session.token", token)):
            if value is not None:
                conf.set(f"fs.s3a.{name}", value)
            else:
                conf.unset(f"fs.s3a.{name}")
        for alias in ("s3", "s3n"):
            conf.set(f"fs.{alias}.impl", "org.apache.hadoop.fs.s3a.S3AFileSystem")
    elif scheme == "gs":
        conf.set("fs.gs.auth.type", "SERVICE_ACCOUNT_JSON_KEYFILE" if keyfile else "UNAUTHENTICATED")
        if keyfile:
            conf.set("fs.gs.auth.service.account.json.keyfile", keyfile)
    else:
        raise ValueError(f"no credentials are known for {scheme}")


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def keys(spark: SparkSession, uri: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(uri, size) of the objects at a place, in order: those that match a wildcard, those in a folder, or the one object."""
    store, path = _path(spark, uri)
    found, todo = [], list(store.globStatus(path) or [])
    top = True
    while todo:
        deeper = []
        for status in todo:
            if status.isFile():
                found.append((status.getPath().toString(), status.getLen()))
            elif top or recursive:
                deeper += list(store.listStatus(status.getPath()))
        todo, top = deeper, False
    return sorted(found)


class Handle:
    """One object, read in ranges; what is not asked for is not fetched."""

    def __init__(self, spark: SparkSession, uri: str):
        found = keys(spark, uri)
        if not found:
            raise FileNotFoundError(f"no object at {uri}")
        if len(found) > 1:
            raise ValueError(f"{len(found)} objects at {uri}")
        self.uri, self.size = found[0]
        self.at, self._jvm = 0, spark.sparkContext._jvm
        store, path = _path(spark, self.uri)
        self._stream = store.open(path)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise ValueError(f"place {at} is before the object")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def read(self, size: int = -1) -> bytes:
        n = max(0, self.size - self.at)
        n = n if size < 0 else min(size, n)
        if not n:
            return b""
        self._stream.seek(self.at)
        self.at += n
        return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n))

    def close(self) -> None:
        self._stream.close()

    def __enter__(self) -> Handle:
        return self

    def __exit__(self, *_) -> None:
        self.close()
