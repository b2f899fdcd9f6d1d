"""Statistics of a text that the quality operators share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

_WS = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
#: Frequent short words of running text in four languages; fixed values.
STOPWORDS = frozenset(
    b"the of and to in a is that for it was on are with as by be this from at de la le les et des en un une du que est pour dans el los las y por para se con der die das und zu den mit von ist auf nicht ein eine sich im".split()
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts beside the base ones: distinct words, stop words, ASCII upper- and lower-case letters, ! and ?,
#: words with a symbol or two ! at the end, sentence ends, lines with a word.
MORE = ("n_distinct", "n_stop", "n_upper", "n_lower", "n_bangs", "n_marked", "n_stops", "n_lines")
NAMES = BASE + MORE


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in NAMES."""
    words = text.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip(_WS):
            lines += 1
            dup += line in seen
            seen.add(line)
    size = len(text)
    without = lambda drop: size - len(text.translate(None, drop))
    counts = Counter(words)
    lower = Counter()
    for w, c in counts.items():
        if len(w) <= 6:
            lower[w.strip(b".,;:").lower()] += c
    return (
        len(words), len(text.translate(None, _WS + _INSIDE)), without(_SYMBOLS), dup, repeat_words(words),
        len(counts), sum(c for w, c in lower.items() if w in STOPWORDS), without(_UPPER), without(_LOWER), without(b"!?"),
        sum(c for w, c in counts.items() if w[-1] in _SYMBOLS or w.endswith(b"!!")), text.count(b". ") + text.count(b".\n") + text.endswith(b"."), lines,
    )


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the counts of NAMES (long) for each row; a null text counts as empty."""
    C.prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(text_stats, C.texts(batch.column(1))), strict=True)) or [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *NAMES])
        C.release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES))
