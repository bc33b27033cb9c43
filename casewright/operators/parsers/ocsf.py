"""Records that are already OCSF: decoded against the event schema, unknown attributes ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schema as S
from casewright.functions import net, scalars
from casewright.operators.parsers.common import PARSE_ERROR, problem

# Time is read as text first: producers send epoch seconds, epoch milliseconds or RFC 3339.
_TEXT_TIME = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "time" else f.dataType) for f in S.EVENT.fields]
)


def parse(df: DataFrame) -> DataFrame:
    decoded = df.withColumn("_doc", F.from_json("raw", _TEXT_TIME))

    def endpoint(name: str):
        value = F.col(f"_doc.{name}")
        return F.when(value.isNotNull(), value.withField("ip", net.canonical_ip(value["ip"])))

    mapped = (
        F.col("_doc")
        .withField("time", scalars.event_time(F.col("_doc.time")))
        .withField("src_endpoint", endpoint("src_endpoint"))
        .withField("dst_endpoint", endpoint("dst_endpoint"))
        .withField("device", endpoint("device"))
        .withField(
            "raw_data", F.coalesce(F.col("_doc.raw_data"), F.substring(F.col("raw"), 1, S.MAX_RAW_DATA))
        )
    )
    bad = problem(
        (F.get_json_object("raw", "$.class_uid").isNull(), PARSE_ERROR, "not an OCSF event: class_uid is missing"),
    )
    return decoded.withColumn("event", mapped).withColumn("problem", bad).drop("_doc")
