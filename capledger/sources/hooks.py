"""Places for parsers and clients that are not part of the library."""

from __future__ import annotations

import multiprocessing
import os
import threading
import time
from collections.abc import Callable, Iterator
from itertools import islice
from multiprocessing import connection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .announcements import Announcements  # noqa: F401  known under this module as well


#: Bytes that a pipe takes at once when it is empty, as that of a child that has answered is.
_AT_ONCE = 16_384
#: Rows of results that go on together.
_ROWS = 500


class Deadline:
    """A function of bytes run in a child process, which is killed and made anew when a call takes too long.

    The child comes by fork, so any function will do; what it returns is pickled.  A child that dies is an error of that
    call alone.  A call may also be made in two steps, start and result, with others under way between them.
    """

    def __init__(self, call: Callable[[bytes], list[str]], seconds: float):
        self.call, self.seconds, self.child, self.sender = call, seconds, None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                content = pipe.recv_bytes()
            except EOFError:
                return
            try:
                pipe.send((True, self.call(content)))
            except BaseException as e:  # noqa: BLE001  whatever it is, the parent is told
                pipe.send((False, f"{type(e).__name__}: {e}"))

    def __call__(self, content: bytes) -> list[str]:
        self.start(content)
        return self.result()

    def start(self, content: bytes) -> None:
        if self.child is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self.child.start()
            theirs.close()
        self.began, self.used = time.monotonic(), _cpu_seconds(self.child.pid)
        if len(content) <= _AT_ONCE:
            self._send(self.pipe, content)
        else:
            # A daemon thread sends, as a child that does not read must not hold the deadline up.
            self.sender = threading.Thread(target=self._send, args=(self.pipe, content), daemon=True)
            self.sender.start()

    def left(self) -> float:
        """Seconds until the deadline of the call under way."""
        return max(0.0, self.began + self.seconds - time.monotonic())

    def idles(self, after: float) -> bool:
        """Whether the call under way has taken so many seconds, and for most of its time no CPU."""
        took = time.monotonic() - self.began
        return took >= after and _cpu_seconds(self.child.pid) - self.used < took / 4

    def result(self) -> list[str]:
        try:
            if not self.pipe.poll(self.left()):
                raise TimeoutError(f"longer than {self.seconds} s")
            ok, result = self.pipe.recv()
        except (EOFError, OSError) as e:
            self.close()
            raise e if isinstance(e, TimeoutError) else RuntimeError("the parser died") from e
        if not ok:
            raise RuntimeError(result)
        return result

    @staticmethod
    def _send(pipe, content: bytes) -> None:
        try:
            pipe.send_bytes(content)
        except OSError:
            pass  # the child is gone, which the reader sees

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            if self.sender is not None:
                self.sender.join()
            self.pipe.close()
            self.child = self.sender = None


def _cpu_seconds(pid: int) -> float:
    """CPU seconds of a process and its children so far; where they can't be read it counts as busy."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            ticks = sum(map(int, f.read().rsplit(")", 1)[1].split()[11:15]))
        total = ticks / os.sysconf("SC_CLK_TCK")
        for task in os.listdir(f"/proc/{pid}/task"):
            with open(f"/proc/{pid}/task/{task}/children") as f:
                total += sum(_cpu_seconds(int(child)) for child in f.read().split())
        return total
    except OSError:
        return time.monotonic()


class _Lane:
    """A file on its way through the parser and, where that fails, the fallback, each in a child of this lane."""

    def __init__(self, calls: list[tuple[str, Deadline]]):
        self.calls = calls

    def start(self, path: str, content: bytes) -> None:
        self.path, self.content, self.stage, self.status, self.error = path, content, 0, None, None
        self.calls[0][1].start(content)

    @property
    def at(self) -> Deadline:
        return self.calls[self.stage][1]

    def step(self, row: Callable) -> tuple | None:
        """The row of the file, if the call under way ends it; else the next call begins."""
        name, call = self.calls[self.stage]
        try:
            return row(self.path, name, call.result(), self.error)
        except Exception as e:  # noqa: BLE001  a broken file is a row of the result
            self.status = self.status or ("timeout" if isinstance(e, TimeoutError) else "failed")
            self.error = self.error or f"{type(e).__name__}: {e}"
        self.stage += 1
        if self.stage == len(self.calls):
            return self.path, self.status, None, self.error
        self.at.start(self.content)
        return None


def _side_by_side(files: Iterator[tuple[str, bytes]], lane: Callable[[], _Lane], row: Callable, most: int, after: float) -> Iterator[tuple]:
    """A row for each file.  One file is parsed at a time; beside calls that only wait, up to most of them, the next begins."""
    busy: list[_Lane] = []
    free: list[_Lane] = []

    def ended(wait: float | None) -> Iterator[tuple]:
        ready = connection.wait([x.at.pipe for x in busy], min([x.at.left() for x in busy] + [wait] * (wait is not None)))
        for x in [x for x in busy if x.at.pipe in ready or not x.at.left()]:
            done = x.step(row)
            if done is not None:
                busy.remove(x)
                free.append(x)
                yield done

    try:
        for path, content in files:
            while len(busy) >= most or not all(x.at.idles(after) for x in busy):
                yield from ended(after if len(busy) < most else None)
            x = free.pop() if free else lane()
            x.start(path, content)
            busy.append(x)
        while busy:
            yield from ended(None)
    finally:
        for x in busy + free:
            for _, call in x.calls:
                call.close()


def pdf_pages(files: DataFrame, parser: Callable[[bytes], list[str]], fallback: Callable[[bytes], list[str]] | None = None, keep_blank: bool = False, timeout: float | None = None, waiting: int = 8) -> DataFrame:
    """path, status, text and error of PDF files (path, content): each page under a mark, by a parser from bytes to page texts.

    A parser that fails, or takes longer than timeout seconds for a file, gives way to fallback (status fallback); where that
    fails as well the text is null and the status timeout or failed.  error tells of the parser.  With a timeout parsers run in
    child processes, so that one that hangs or crashes costs its file and not the task.  A task then has up to so many waiting
    parsers: when one takes a sixteenth of the timeout without using its CPU, the next file is begun beside it.
    """
    ways = [(name, how) for how, name in ((parser, "parsed"), (fallback, "fallback")) if how is not None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((path, content) for pdf in batches for path, content in zip(pdf["path"], pdf["content"], strict=True))
        if timeout is None:
            rows = (one(path, content) for path, content in each)
        else:
            rows = _side_by_side(each, lambda: _Lane([(name, Deadline(how, timeout)) for name, how in ways]), row, max(1, waiting), timeout / 16)
        try:
            while some := list(islice(rows, _ROWS)):
                yield pd.DataFrame(some, columns=["path", "status", "text", "error"])
        finally:
            rows.close()

    def row(path: str, name: str, pages: list[str], error: str | None) -> tuple:
        return path, name, "\n\n".join(f"## 第{i}页\n\n{p.strip()}" for i, p in enumerate(pages, 1) if keep_blank or p.strip()), error

    def one(path: str, content: bytes) -> tuple:
        error = status = None
        for name, call in ways:
            try:
                return row(path, name, call(content), error)
            except Exception as e:  # noqa: BLE001  a broken file is a row of the result
                status = status or ("timeout" if isinstance(e, TimeoutError) else "failed")
                error = error or f"{type(e).__name__}: {e}"
        return path, status, None, error

    return files.select("path", "content").mapInPandas(run, "path string, status string, text string, error string")


def render_prompt(docs: DataFrame, template: str, text: str = "text", most: int | None = None) -> DataFrame:
    """docs with prompt: the template with {text} replaced by the text, or its first most characters; braces in it are left alone."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("prompt", F.replace(F.lit(template), F.lit("{text}"), whole if most is None else F.left(whole, F.lit(most))))


def ask(prompts: DataFrame, client: Callable[[str], str], key: str = "company") -> DataFrame:
    """key and reply of each prompt, by a client that the caller brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "reply": [client(p) for p in pdf["prompt"]]})

    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, reply string")


def step_metrics(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, object]:
    """df, and an observation that counts its rows (and more) while it is written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), seen
