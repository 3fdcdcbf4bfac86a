"""Log schemas: the structure of a source's logs from their first line, and the profile of their services and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of a supercomputer's log line (time, date, node, device, RAS, component, level, message) and its parts.
LINE = r"^(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(RAS)\s+(\w+)\s+(\w+)\s+(.*)$"
PARTS = ("unix_ts", "date", "node", "device", "component", "sub_component", "level", "message")
#: Fixed value: ids whose number is counted (four groups of hexadecimal digits); a parameter where others are meant.
ID_PATTERN = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
_ATTRIBUTE = "array<struct<key:string,value:struct<stringValue:string>>>"
_BATCH = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTE}>,scopeLogs:array<struct<logRecords:"
    "array<struct<timeUnixNano:string,severityText:string,body:struct<stringValue:string>>>>>>>"
)


def parsed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The eight parts of each line that the pattern fits; other lines give none."""
    fits = lines.where(F.trim(column).rlike(LINE))
    return fits.select("*", *[F.regexp_extract(F.trim(column), LINE, i + 1).alias(p) for i, p in enumerate(PARTS)])


def schemas(lines: DataFrame) -> DataFrame:
    """Per source (source, line_no, line) the fields of its first line: a nested JSON batch, else the line pattern, else no row."""
    first = lines.groupBy("source").agg(F.min_by("line", "line_no").alias("line"))
    j = F.from_json("line", _BATCH)["resourceLogs"]
    record = F.get(F.get(F.get(j, F.lit(0))["scopeLogs"], F.lit(0))["logRecords"], F.lit(0))
    service = F.get(F.filter(F.get(j, F.lit(0))["resource"]["attributes"], lambda a: a["key"] == "service.name"), F.lit(0))["value"]["stringValue"]
    is_json = F.get_json_object("line", "$").isNotNull() & F.substring(F.trim("line"), 1, 1).isin("{", "[")
    fields = lambda *of: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.coalesce(s, F.lit("")).alias("source_field")) for (n, t), s in zip((("timestamp", "datetime"), ("level", "keyword"), ("service", "keyword"), ("message", "string")), of, strict=True)])
    found = F.when(is_json, fields(record["timeUnixNano"], record["severityText"], service, record["body"]["stringValue"])).when(
        F.trim("line").rlike(LINE), fields(F.lit("unix_ts"), F.lit("level"), F.lit("node"), F.lit("message"))
    )
    return first.select("source", found.alias("fields")).where("fields IS NOT NULL")


def profile(logs: DataFrame, column: str = "line", pattern: str = ID_PATTERN) -> DataFrame:
    """Per service and level how many JSON logs there are, and how many distinct ids each holds, summed; others are left out."""
    get = lambda path, other: F.coalesce(F.nullif(F.get_json_object(column, path), F.lit("")), F.lit(other))
    ids = F.size(F.array_distinct(F.regexp_extract_all(get("$.body.stringValue", ""), F.lit(pattern), F.lit(0))))
    rows = logs.where(F.get_json_object(column, "$").isNotNull()).select(
        get("$.resource.attributes['service.name']", "unknown").alias("service"), get("$.severityText", "INFO").alias("level"), ids.alias("ids")
    )
    return rows.groupBy("service", "level").agg(F.count("*").alias("frequency"), F.sum("ids").alias("cardinality"))
