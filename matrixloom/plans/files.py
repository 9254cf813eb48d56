"""Small files on any file system Hadoop knows: manifests, references, snapshots. Data goes through Spark's writers."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from ..errors import StorageError

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://")


# How each storage is logged in to, and the settings of its connector that read without credentials.
LOGIN = {"s3": "`aws sso login`, AWS_* variables or an instance role", "s3a": "`aws sso login`, AWS_* variables or an instance role", "gs": "`gcloud auth application-default login`", "gcs": "`gcloud auth application-default login`"}
_S3_ANONYMOUS = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}
ANONYMOUS = {"s3": _S3_ANONYMOUS, "s3a": _S3_ANONYMOUS, "gs": {"fs.gs.auth.type": "UNAUTHENTICATED"}, "gcs": {"fs.gs.auth.type": "UNAUTHENTICATED"}}


def scheme(path: str) -> str:
    """The scheme of a URI, `file` for a plain path."""
    found = _SCHEME.match(path)
    return found[1].lower() if found else "file"


def is_remote(path: str) -> bool:
    return scheme(path) != "file"


def is_read_only(path: str) -> bool:
    """Schemes that can only be read."""
    return scheme(path) in ("http", "https")


def canonical(path: str) -> str:
    """A path without trailing slashes; file:// URIs become plain paths."""
    path = path.removeprefix("file://") if scheme(path) == "file" else path
    return path.rstrip("/") or "/"


def name_of(path: str) -> str:
    """The last part of a path."""
    return canonical(path).rsplit("/", 1)[-1]


class Files:
    """Reads and writes below a root. Creation without overwriting is the only primitive that concurrent writers need.

    HDFS and local folders create atomically. On object stores two writers can both believe that they created a file, unless the
    connector creates conditionally; let one writer at a time commit there. anonymous: read public data without credentials.
    """

    def __init__(self, spark: SparkSession, root: str, *, anonymous: bool = False):
        self.spark, self.root = spark, canonical(root)
        self.options = dict(ANONYMOUS.get(scheme(root), {})) if anonymous else {}
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        with self._explained():
            if self.options:
                self._conf = self._jvm.org.apache.hadoop.conf.Configuration(self._conf)
                for name, value in self.options.items():
                    self._conf.set(name, value)
                self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(self._path("").toUri(), self._conf)  # not the cached one
            else:
                self._fs = self._path("").getFileSystem(self._conf)

    @contextmanager
    def _explained(self):
        """A failure to reach the storage as a StorageError that says how to log in."""
        try:
            yield
        except Py4JError as e:
            how = LOGIN.get(scheme(self.root))
            hint = f". Credentials come from the environment: {how}; or pass anonymous=True for public data" if how else ""
            raise StorageError(f"{self.root} can't be reached: {_reason(e)}{hint}") from e

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        with self._explained():
            return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, in order; nothing if there is none."""
        if not self.exists(name):
            return []
        with self._explained():
            return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> dict:
        try:
            stream = self._fs.open(self._path(name))
        except Exception as e:
            raise StorageError(f"{self.uri(name)} can't be read: {_reason(e)}") from e
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def create(self, name: str, value: dict) -> bool:
        """Writes a new file; False if there is one already."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise StorageError(f"{self.uri(name)} can't be written: {_reason(e)}") from e
        stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        stream.close()
        return True

    def replace(self, name: str, value: dict) -> None:
        """Puts a file in place of another: written beside it, then renamed over it."""
        import uuid

        beside = f"{name}.{uuid.uuid4().hex}"
        self.create(beside, value)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if is_remote(self.root) else self._jvm.java.net.URI("file:///"), self._conf).rename(self._path(beside), self._path(name), kinds)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def copy_tree(self, other: Files, *, last: tuple[str, ...] = (), threads: int = 16) -> None:
        """Copies all files to another root, byte by byte, several at a time; names that begin with one of `last` come after all others, in order."""
        found, names = self._fs.listFiles(self._path(""), True), []
        base = self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        while found.hasNext():
            names.append(found.next().getPath().toString().removeprefix(base))

        def one(name: str) -> None:
            if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), other._fs, other._path(name), False, False, self._conf):
                raise StorageError(f"{self.uri(name)} can't be copied to {other.root}")

        rank = lambda name: next((i for i, x in enumerate(last) if name.startswith(x)), -1)
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(one, (x for x in names if rank(x) < 0)))
        for name in sorted((x for x in names if rank(x) >= 0), key=lambda x: (rank(x), x)):
            one(name)


def _reason(e: Exception) -> str:
    cause = getattr(e, "java_exception", None)
    return (cause.toString() if cause is not None else str(e)).split("\n")[0][:200]
