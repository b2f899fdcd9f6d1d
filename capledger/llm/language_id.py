"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Lengths of n-grams in characters, ranks of a profile, folds (fold 0 is held out).
LENGTHS, RANKS, FOLDS = (1, 2, 3), 400, 5
#: Characters that are counted at a time, and distinct n-grams that a task holds before it hands them on.
CHUNK, HELD = 1 << 19, 1 << 21
#: A profile table of more languages than this is an error: it would not be small.
MOST_LANGUAGES = 1000
#: Stands for a run of characters that are not letters.
GAP = 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else GAP."""
    return np.array([c if chr(c).isalpha() else GAP for c in range(0x110000)], np.uint32)


def characters(text: bytes) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters is one GAP, and one stands at either end."""
    raw = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[GAP], _letters()[raw], [GAP]]).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != GAP) | (c[:-1] != GAP)
    return c[keep]


def grams(c: np.ndarray) -> np.ndarray:
    """Codes of all n-grams: 21 bits a character, so no two n-grams share a code.  A lone GAP is none."""
    out = [c[c != GAP]]
    for n in LENGTHS[1:]:
        code = np.zeros(max(0, len(c) - n + 1), np.int64)
        for i in range(n):
            code = (code << 21) | c[i : len(c) - n + 1 + i]
        out.append(code)
    return np.concatenate(out)


def counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; long texts are counted in overlapping pieces."""
    if len(c) <= CHUNK:
        return np.unique(grams(c), return_counts=True)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(c), CHUNK):
        piece = c[i : i + CHUNK]
        one, two, three = grams(piece), c[max(0, i - 1) : i + 1], c[max(0, i - 2) : i + 2]
        # n-grams over the border of two pieces
        cross = [two[0] << 21 | two[1]] if i else []
        cross += [a << 42 | b << 21 | d for a, b, d in zip(three, three[1:], three[2:], strict=False)] if i else []
        codes, at = np.unique(np.concatenate([codes, one, np.array(cross, np.int64)]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(counts), np.int64)]), len(codes)).astype(np.int64)
    return codes, counts


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent n-grams, of equal counts the smaller code first."""
    if len(codes) > RANKS:
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:RANKS]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, code and count n of each language's RANKS most frequent n-grams, from the texts with a language.

    Counts cover all the texts: each task counts its own, a shuffle adds them up by language and n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                for i in range(0, len(codes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[i : i + (1 << 16)]), pa.string()), pa.array(codes[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), C.texts(batch.column(1)), strict=True):
                c = characters(text)
                if len(c) > CHUNK:
                    held.setdefault(lang, []).append(counted(c))
                    size += len(held[lang][-1][0])
                else:
                    by_lang.setdefault(lang, []).append(grams(c))
            for lang, parts in by_lang.items():
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                size += len(held[lang][-1][0])
            if size > HELD:
                yield from rows()
                size = 0
        yield from rows()

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    total = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    # The best of each partition, then the best of those: no task gets all n-grams of a language.
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                codes, n = part["code"].to_numpy(), part["n"].to_numpy()
                if lang in most:
                    codes, n = np.concatenate([most[lang][0], codes]), np.concatenate([most[lang][1], n])
                order = np.lexsort((codes, -n))[:RANKS]
                most[lang] = codes[order], n[order]
        for lang, (codes, n) in most.items():
            yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["n", "code"], ascending=[False, True]).head(RANKS)

    return total.mapInPandas(best, "lang string, code long, n long").groupBy("lang").applyInPandas(last, "lang string, code long, n long")


class Profiles:
    """Ranks of all profiles' n-grams: a row for each n-gram, a column for each language."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows["lang"].unique())
        self.codes = np.unique(rows["code"].to_numpy(np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            part = rows[rows["lang"] == lang]
            best = top(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
            self.ranks[np.searchsorted(self.codes, best), i] = np.arange(len(best))

    def judge(self, text: bytes | None) -> tuple[str, float]:
        """Language of least out-of-place distance (of equals the first by name) and 1 - distance / most distance."""
        c = characters(text or b"")
        if len(c) < 2 or not self.langs:
            return "und", 0.0
        mine = top(*counted(c))
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != mine] = len(self.codes)
        ranks = self.ranks[at]
        place = np.arange(len(mine))[:, None]
        far = np.where(ranks < 0, RANKS, np.abs(ranks - place)).sum(0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (RANKS * len(mine)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """Return doc_id, held_out, lang_pred, score for each row.

    A profile of the RANKS most frequent n-grams is learned for each language from the rows outside fold 0
    (crc32 of the id as text, modulo folds) with a language; each text's own most frequent n-grams are then
    compared to every profile by out-of-place distance.  score is 1 - distance / the most it can be.  A null
    text or one without letters is und with score 0; so is every text if nothing was learned.  Whole texts
    are read; repeated rows each give a row, and count as often in learning; an empty table gives an empty result;
    other columns are not read.  More than MOST_LANGUAGES languages are an error.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    fold = C.crc_fold(F.col(id_col), folds)
    # Told before anything is learned or comes to the driver, by a scan of two narrow columns.
    if docs.where((fold != 0) & F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages, which is what the profiles hold")
    rows = learn(docs.where(fold != 0), text_col, lang_col).toPandas()
    profiles = spark.sparkContext.broadcast(Profiles(rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.value.judge(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), F.col(text_col).cast("binary").alias("text")).mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language_id over documents: nulls, ties, repeated rows and empty tables as there."""
    return language_id(C.table(spark, sf_dir, "documents"))


#: The code's order is that of the length and then of the code points, which is that of the text's bytes.
_RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY n DESC, length(g), g) - 1"
SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, lang, {C.sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % {FOLDS} AS fold,
         regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS c
  FROM documents, (SELECT {C.SQL_CRC_TABLE} AS crc_table)
), e AS (
  SELECT row, fold, lang, unnest(string_split(c, '')) AS x, generate_subscripts(string_split(c, ''), 1) AS i FROM d
), t AS (
  SELECT row, fold, lang, x, lead(x) OVER w AS y, lead(x, 2) OVER w AS z FROM e WINDOW w AS (PARTITION BY row ORDER BY i)
), g AS (
  SELECT row, fold, lang, x AS g FROM t WHERE x <> ' ' UNION ALL SELECT row, fold, lang, x || y FROM t WHERE y IS NOT NULL UNION ALL SELECT row, fold, lang, x || y || z FROM t WHERE z IS NOT NULL
), own AS (
  SELECT row, g, {_RANKED.format("row")} AS place FROM (SELECT row, g, count(*) AS n FROM g GROUP BY row, g) QUALIFY place < {RANKS}
), profile AS (
  SELECT lang, g, {_RANKED.format("lang")} AS rank FROM (SELECT lang, g, count(*) AS n FROM g WHERE fold <> 0 AND lang IS NOT NULL GROUP BY lang, g) QUALIFY rank < {RANKS}
), sizes AS (
  SELECT row, count(*) AS n FROM own GROUP BY row
), nearer AS (
  SELECT row, lang, sum({RANKS} - abs(rank - place)) AS s FROM own JOIN profile USING (g) GROUP BY row, lang
), far AS (
  SELECT row, l.lang, n, n * {RANKS} - coalesce(s, 0) AS far FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN nearer USING (row, lang)
), best AS (
  SELECT row, lang, 1 - far::DOUBLE / ({RANKS} * n) AS score FROM far QUALIFY row_number() OVER (PARTITION BY row ORDER BY far, lang) = 1
)
SELECT doc_id, fold = 0 AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM d LEFT JOIN best USING (row)
"""
