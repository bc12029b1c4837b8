"""Rows from raw pages and files: paragraphs, links, headings, registries, raw artifacts, strict JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import decode_entities, normalize_ws


def without_markup(html: Column) -> Column:
    return normalize_ws(F.regexp_replace(html, "<[^>]*>", " "))


def body_of(html: Column) -> Column:
    """The html without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")


def paragraphs(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, n and text of each paragraph that isn't blank; a paragraph ends where the next begins or a block closes."""
    found = F.regexp_extract_all(body_of(F.col(html_col)), F.lit(r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p>|</div>|</article>|</body>|\z)"), F.lit(1))
    texts = F.filter(F.transform(found, without_markup), lambda t: t != "")
    return pages.select(F.col(id_col).alias("id"), F.posexplode(texts).alias("n", "text"))


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, n, href and text of each link."""
    html = body_of(F.col(html_col))
    pattern = F.lit(r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(both).alias("n", "a")).select("id", "n", decode_entities(F.col("a.href")).alias("href"), without_markup(F.col("a.text")).alias("text"))


def headings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, n, level and text of each heading."""
    html = body_of(F.col(html_col))
    pattern = F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>")
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("level"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(both).alias("n", "h")).select("id", "n", F.col("h.level").cast("int").alias("level"), without_markup(F.col("h.text")).alias("text"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """host and path of a URL."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def markdown_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the pipe-delimited tables in a Markdown catalogue, as arrays of trimmed cells; rulers and other lines are left out."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    return lines.select(cells.alias("cells")).where(~F.forall("cells", lambda c: F.regexp_like(c, F.lit("^:?-+:?$"))))


def registry_problems(registry: DataFrame, id_col: str, required: list[str]) -> DataFrame:
    """id and problem: blank or repeated ids, and blank required fields."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(f"missing {c}")) for c in [id_col, *required]]))
    fields = registry.select(F.col(id_col).alias("id"), F.explode(missing).alias("problem"))
    repeated = registry.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return fields.union(repeated)


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def raw_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, raw_hash and text (as windows-1252) of landed files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("raw_hash"), F.decode("content", "windows-1252").alias("text"))


def service_rows(pages: DataFrame, body_col: str, row_schema: str) -> DataFrame:
    """The rows under value, results or d.results of a JSON service's pages."""
    found = F.coalesce(*[F.get_json_object(body_col, p) for p in ("$.d.results", "$.value", "$.results")])
    return pages.select(F.explode(F.from_json(found, f"array<{row_schema}>")).alias("r")).select("r.*")
