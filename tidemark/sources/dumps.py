"""Readers of text: pageview dumps, replica exports and lists of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import access_code, edition_code, u32


FILE_DAY = r"([0-9]{8})[^/0-9]*$"


class EmptyDump(ValueError):
    """A dump without one valid line."""


def parse_dump_lines(lines: DataFrame, date: Column) -> DataFrame:
    """(domain, page_id, access_method, daily_views, date) of ``domain title page_id access views [rest]`` lines in ``value``.

    Lines with fewer than five fields or a bad number are dropped; title and rest are ignored.
    """
    # The explode of one row keeps Spark from putting the split, and what makes ``value``, in place of each use of a field.
    rows = lines.select(F.explode(F.array(F.split("value", " ", 6))).alias("__f"), date.alias("date")).where(F.size("__f") >= 5)
    field = F.col("__f")
    return rows.select(
        field[0].alias("domain"), u32(field[2]).alias("page_id"), field[3].alias("access_method"), u32(field[4]).alias("daily_views"), "date",
    ).where("page_id is not null and daily_views is not null")


def normalize_pageviews(parsed: DataFrame, hyphens: bool = True) -> DataFrame:
    """Raw pageviews with edition codes and access codes."""
    return parsed.select(
        edition_code(F.col("domain"), hyphens).alias("wiki"), "page_id",
        access_code(F.col("access_method")).alias("access_method"), "daily_views", "date",
    )


def read_pageview_dump(spark: SparkSession, path: str | list[str], date: str | None = None, check: bool = True, file_day: str = FILE_DAY) -> DataFrame:
    """Normalised pageviews of dump files, compressed or not.

    Without ``date`` each file's day is the first group of ``file_day`` in its path, by default the last eight digits of its name. A dump without a valid line raises
    EmptyDump when ``check`` is on.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    name = F.regexp_extract(F.input_file_name(), file_day, 1)
    on = F.lit(date).cast("date") if date else F.to_date(F.nullif(name, F.lit("")), "yyyyMMdd")
    found = normalize_pageviews(parse_dump_lines(lines, on))
    if check and found.isEmpty():
        raise EmptyDump(f"no valid line in {path}")
    return found


def parse_replica_tsv(lines: DataFrame, columns: list[str], numbers: set[str]) -> DataFrame:
    """Rows of tab-separated lines in ``value``; lines with too few fields or a bad number, headers included, are dropped."""
    field = F.split("value", "\t", -1)
    typed = [(u32(field[i]) if c in numbers else field[i]).alias(c) for i, c in enumerate(columns)]
    good = F.lit(True)
    for c in columns:
        if c in numbers:
            good &= F.col(c).isNotNull()
    return lines.where(F.size(field) >= len(columns)).select(*typed).where(good)


# Editions that are left out by the start of their name.
LEFT_OUT = ("arbcom", "test", "sysop", "wg_en", "cebwiki", "warwiki", "be_x_old")


def wiki_editions(names: DataFrame, closed: DataFrame) -> DataFrame:
    """Active editions, sorted: names in ``value`` that end in wiki and are neither comments, closed nor left out."""
    wanted = F.col("value").endswith("wiki") & ~F.col("value").startswith("#")
    for start in LEFT_OUT:
        wanted &= ~F.col("value").startswith(start)
    open_names = names.where(wanted).join(closed.select("value"), "value", "left_anti")
    return open_names.select(F.col("value").alias("wiki")).distinct().orderBy("wiki")


SITE = "struct<code:string,url:string,dbname:string,sitename:string,closed:string,private:string>"


def site_matrix_editions(documents: DataFrame) -> DataFrame:
    """(code, name, dbname, url) of the open encyclopaedias in site-matrix documents in ``value``, by name, then code.

    Each entry of the matrix is a language with its sites; entries that are none (the count, the specials) are passed over.
    """
    matrix = F.from_json(F.get_json_object("value", "$.sitematrix"), "map<string,string>")
    entry = f"struct<code:string,name:string,site:array<{SITE}>>"
    languages = documents.select(F.explode(matrix).alias("k", "v")).where(F.col("k").rlike("^[0-9]+$"))
    sites = languages.select(F.from_json("v", entry).alias("l")).select("l.code", "l.name", F.explode("l.site").alias("s"))
    wanted = sites.where("s.code = 'wiki' and s.closed is null and s.private is null")
    first = Window.partitionBy("code").orderBy("s.dbname")
    kept = wanted.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.select("code", "name", "s.dbname", "s.url").orderBy("name", "code")
