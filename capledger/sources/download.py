"""Downloads as a data sink: rows of url and file name are fetched by the tasks, and files appear when all have ended."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import share_package
from .announcements import LONGEST_WAIT, load

LOG = "url string, file_name string, status string, code long, attempts long, size long, md5 string, error string"
#: A code that no further attempt will change, and the bytes that a file begins with.
NOT_FOUND, MAGIC = 404, b"%PDF"


@dataclass
class _Done(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own; commit moves the folders of the attempts that ended well."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.attempts, self.wait = int(options.get("attempts", "5")), float(options.get("wait", "1"))
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"].rstrip("/")
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._store()
        task = TaskContext.get()
        folder = f"{root}/_staging/{self.job}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        store.create_dir(folder)
        fetch = load(self.options["fetch"])(self.options)
        with store.open_output_stream(f"{folder}/_log") as log:
            for row in iterator:
                log.write(json.dumps(self._one(store, root, folder, fetch, row["url"], row["file_name"]), ensure_ascii=False).encode() + b"\n")
        return _Done(folder)

    def _one(self, store: fs.FileSystem, root: str, folder: str, fetch: Callable, url: str, name: str) -> dict:
        out = {"url": url, "file_name": name, "status": "failed", "code": None, "attempts": 0, "size": None, "md5": None, "error": None}
        if not name or "/" in name or name.startswith(("_", ".")):
            return out | {"error": "no file name"}
        if not self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            return out | {"status": "exists"}
        for attempt in range(1, self.attempts + 1):
            out["attempts"] = attempt
            try:
                out["code"], chunks = fetch(url)
                out["error"] = None
                if out["code"] == NOT_FOUND:
                    return out | {"status": "not_found"}
                if out["code"] == 200:
                    size, md5 = self._save(store, f"{folder}/{name}", chunks)
                    return out | {"status": "success", "size": size, "md5": md5}
                out["error"] = f"code {out['code']}"
            except Exception as e:  # noqa: BLE001  a file that fails is a row of the log
                out["error"] = f"{type(e).__name__}: {e}"
            if attempt < self.attempts:
                time.sleep(min(self.wait * (2 ** (attempt - 1) + random.random()), LONGEST_WAIT))
        return out

    def _save(self, store: fs.FileSystem, path: str, chunks: Iterator[bytes]) -> tuple[int, str]:
        """Write chunk by chunk; what does not begin as a file should is deleted."""
        digest, size, start = hashlib.md5(), 0, b""
        try:
            with store.open_output_stream(path) as out:
                for chunk in chunks:
                    start = (start + chunk)[: len(MAGIC)] if size < len(MAGIC) else start
                    out.write(chunk)
                    digest.update(chunk)
                    size += len(chunk)
            if start != MAGIC:
                raise ValueError("not a PDF")
        except Exception:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)
            raise
        return size, digest.hexdigest()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files by renaming, the logs last; a commit that is cut short leaves whole files, which the next run finds."""
        store, root = self._store()
        store.create_dir(f"{root}/_log")
        for n, done in enumerate(m for m in messages if m is not None):
            for info in store.get_file_info(fs.FileSelector(done.folder)):
                if info.base_name != "_log":
                    store.move(info.path, f"{root}/{info.base_name}")
            store.move(f"{done.folder}/_log", f"{root}/_log/{self.job}-{n}.json")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Everything that this job staged goes, whatever attempt made it."""
        store, root = self._store()
        staged = f"{root}/_staging/{self.job}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class Downloads(DataSource):
    """format("downloads"): writes rows of url and file_name as files of a folder that all tasks and the driver share.

    Options: path; fetch (module:function of the options, giving fetch(url) -> (code, chunks of bytes)); attempts, and
    wait in seconds, which doubles and gets up to a second's share of chance.  404 ends a row at once; any other code,
    an exception, and content that is no PDF are tried again.  Mode append leaves files that exist alone, overwrite
    fetches them again.  Files appear at the commit; a task that is lost, or a job that fails, leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def schema(self) -> str:
        return "url string, file_name string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def download(rows: DataFrame, path: str, fetch: str, mode: str = "append", **options) -> DataFrame:
    """Fetch rows (url, file_name; names once each) to path; the log of all runs, a row for each file and run."""
    spark = rows.sparkSession
    share_package(spark)
    spark.dataSource.register(Downloads)
    rows.select("url", "file_name").write.format("downloads").mode(mode).options(path=path, fetch=fetch, **options).save()
    return download_log(spark, path)


def download_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{path.rstrip('/')}/_log")
