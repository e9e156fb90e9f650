"""Sources and sinks: report folders, JSON lines, knowledge-base CSV, web pages, pages of printed reports and stage tables.

Edge cases: empty files and blank lines give no rows; null texts and pages give none; repeated files of one name in different folders are reports of their
own text under one id; CSV fields that are missing are null; an empty folder of JSON gives an error of the reader, as it has no files; extra columns are
not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, text): one row for each non-empty .txt file; the id is the file's stem."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return rows.select(name.alias("report_id"), F.col("value").alias("text")).where("trim(text) <> ''")


def chunks(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, chunk, text): the non-empty lines of a report, numbered as they stand."""
    return reports.select(key, F.posexplode(F.split(text, "\n", -1)).alias("chunk", "text")).where("trim(text) <> ''")


def json_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, chunk, text): reports that are JSON lists of (id, text), one file each; the report's id is the file's stem, a chunk's its place."""
    schema = "array<struct<id:string,text:string>>"
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    listed = rows.select(name.alias("report_id"), F.from_json("value", schema).alias("c"))
    return listed.select("report_id", F.posexplode("c").alias("chunk", "x")).select("report_id", "chunk", F.col("x.text").alias("text")).where("trim(text) <> ''")


#: What the pages of contents begin with, and what ends a report past its middle.
CONTENTS = r"(?i)(\n|^)(table of contents|contents|list of figures|list of tables)\n"
ENDINGS = r"(?i)(\n|^)(REFERENCES\n|Acknowledgements\n|Appendix\b)"


def paged_reports(pages: DataFrame, key: str = "report_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, text): the pages of a printed report (from any extractor), numbered from 1, as one text: up to the first page past the middle that begins the references,
    without pages of contents, words broken at line ends joined."""
    n = pages.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.when(F.col(text).rlike(ENDINGS), F.col(page))).alias("_any"))
    rows = pages.join(n.select(key, "_n"), key)
    past = rows.where(F.col(text).rlike(ENDINGS) & (2 * F.col(page) > F.col("_n"))).groupBy(key).agg(F.min(page).alias("_end"))
    kept = rows.join(past, key, "left").where((F.col("_end").isNull() | (F.col(page) < F.col("_end"))) & F.col(text).isNotNull() & ~F.col(text).rlike(CONTENTS))
    whole = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, F.trim(text).alias("_t")))).alias("_p"))
    return whole.select(key, F.trim(F.replace(F.array_join(F.col("_p._t"), " "), F.lit("-\n"), F.lit(""))).alias("text"))


def procedures(spark: SparkSession, path: str, techs: list[str] | None = None) -> DataFrame:
    """Knowledge-base rows: technique id, platforms, id and description; techs: only those of these techniques."""
    rows = spark.read.csv(path, header=True, schema="tech_id string, platform string, id string, description string")
    rows = rows if techs is None else rows.where(F.col("tech_id").isin(techs))
    listed = F.filter(F.split(F.regexp_replace("platform", r"[\[\]' ]", ""), ","), lambda x: x != "")
    return rows.withColumn("platforms", listed)


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section, text): the text between h1 to h3 headings, tags stripped and white space collapsed; text before the first heading
    is left out, and so are tables, figures and images."""
    html = F.regexp_replace(html, "(?s)<(table|figure)[^>]*>.*?</(table|figure)>|<img[^>]*>", " ")
    parts = F.split(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<h[1-3][^>]*>", -1)
    rows = pages.select(key, F.posexplode(parts).alias("section", "raw")).where("section > 0")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), "[ \n\t\r]+", " "))
    return rows.select(key, "section", text.alias("text"))
