"""Announcements, versions and download attempts.  Nothing here uses a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import select as S


def title_kept(title: Column, include: str = P.TITLE_INCLUDE, exclude: Sequence[str] = P.TITLE_EXCLUDE_SHORT) -> Column:
    """Titles that name a prospectus and none of the words to leave out; null is not kept."""
    return F.coalesce(title.rlike(include) & ~title.rlike("|".join(exclude)), F.lit(False))


def title_kept_strict(title: Column) -> Column:
    return F.coalesce(title.contains("招股说明书") & ~title.rlike("|".join(P.TITLE_EXCLUDE)), F.lit(False))


def version_of(title: Column, versions: Sequence[str] = P.VERSIONS) -> Column:
    """Version that the title names; the last of versions if it names none."""
    out = F.lit(versions[-1])
    for v in reversed(versions[:-1]):
        out = F.when(title.contains(v), v).otherwise(out)
    return out


def priority_of(version: Column, versions: Sequence[str] = P.VERSIONS) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in versions]), version)


def prospectuses(announcements: DataFrame, base: str) -> DataFrame:
    """stock_code, title, url, version, date, priority, ord of the announcements that are prospectuses."""
    kept = announcements.where(title_kept(F.col("announcementTitle")))
    version = version_of(F.col("announcementTitle"))
    return kept.select("stock_code", F.col("announcementTitle").alias("title"), T.absolute_url(F.col("adjunctUrl"), base).alias("url"), version.alias("version"), F.left("announcementDate", F.lit(10)).alias("date"), priority_of(version).alias("priority"), "ord")


def best_prospectus(rows: DataFrame) -> DataFrame:
    return S.best(rows, ["stock_code"], ["priority", "ord"])


def search_with_retry(companies: DataFrame, announcements: DataFrame) -> DataFrame:
    """companies with the title found by full name, and by short name where that finds none."""
    return S.two_step_match(companies, announcements, (F.col("company_full_name"), "full_name"), (F.col("company_short_name"), "short_name"), "title", "title")


def to_search(companies: DataFrame) -> DataFrame:
    """Companies whose prospectus_url is still blank."""
    return companies.where(F.trim(F.coalesce("prospectus_url", F.lit(""))) == "")


def file_accepted(content: Column, length: Column, least: int = 1 << 20, most: int = 100 << 20) -> Column:
    """A PDF by its first bytes, of an acceptable size."""
    return F.coalesce((F.substring(content, 1, 5) == F.lit(b"%PDF-")) & length.between(least, most), F.lit(False))


def attempt_log(files: DataFrame) -> DataFrame:
    """path, status, size_mb, md5, error of downloaded files (path, content, length)."""
    ok = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return files.select("path", F.when(ok, "success").otherwise("failed").alias("status"), F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), F.md5("content").alias("md5"), F.when(~ok, "not a PDF").alias("error"))


def response_ok(code: Column, size: Column, least: int = 50_000) -> Column:
    return F.coalesce((code == 200) & (size >= least), F.lit(False))


def download_report(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    """companies with downloaded: whether any attempt of theirs succeeded."""
    return S.has_partner(companies, attempts.where("status = 'success'"), ["stock_code"], "downloaded")
