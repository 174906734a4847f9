"""Tables as the operators want them: each row once, sentinels as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import package_class, package_of
from ..session import table

SPAN_COLUMNS = ["span_id", "container", "container_id", "track", "depth", "seq", "start_ns", "end_ns", "start_event", "end_event", "at_frame", "state", "tags", "kind"]


def spans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Spans, repeats taken once: they agree in all columns but ingested_at.

    Only the named columns (and span_id) are read and compared.
    """
    cols = list(dict.fromkeys(["span_id", *(columns or SPAN_COLUMNS)]))
    return table(spark, sf_dir, "spans").select(*cols).distinct()


def goroutines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["g_id", "seq_id", "parent", "func", "start_ns", "end_ns", "eff_start", "eff_end"]
    return table(spark, sf_dir, "goroutines").select(*cols).distinct()


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain `events` table as a canonical event log.

    user_id is the goroutine, user_id mod 8 the processor, event_type the state
    that begins, and k of props the depth of a made-up stack.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"),
        F.col("user_id").alias("g"),
        F.pmod(F.col("user_id"), F.lit(8)).alias("p"),
        F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("bigint").alias("value"),
        k.alias("k"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain `events` table as a log of ranges, tasks, logs and samples.

    signup begins and purchase ends the task of the user, whose parent is the
    user's id without its last digit; click begins and error ends a range whose
    name and owner follow k; views are Sync, RangeActive, samples and logs by k.
    """
    k = F.col("k")
    name = F.element_at(F.array(*map(F.lit, ("GC concurrent mark phase", "stop-the-world (sweep)", "GC mark assist", "GC incremental sweep", "thread work"))), (k % 5 + 1).cast("int"))
    scope = F.when(k % 5 == 3, "Proc").when(k % 5 == 4, "Thread").otherwise("None")
    kind = F.when(F.col("kind") == "signup", "TaskBegin").when(F.col("kind") == "purchase", "TaskEnd").when(F.col("kind") == "click", "RangeBegin").when(F.col("kind") == "error", "RangeEnd")
    kind = kind.when(k % 50 == 49, "Sync").when(k % 10 == 8, "RangeActive").when(k % 2 == 1, "StackSample").otherwise("Log")
    return log(spark, sf_dir).select(
        "event_id", "ts", kind.alias("kind"), "g", F.when(k % 3 != 0, F.col("p")).alias("p"), F.lit(None).cast("bigint").alias("stack_id"), "k",
        F.lit(None).cast("struct<res_kind:string,res_id:bigint,from_state:string,to_state:string,reason:string,stack_id:bigint>").alias("trans"),
        F.struct(name.alias("name"), scope.alias("scope_kind"), F.col("p").alias("scope_id"), F.create_map(F.lit("bytes swept"), F.col("value"), F.lit("bytes reclaimed"), k).alias("attrs")).alias("range"),
        F.struct(F.col("g").alias("id"), F.expr("g div 10").alias("parent"), F.concat(F.lit("job "), (k % 7).cast("string")).alias("type")).alias("task"),
        F.struct(F.expr("g div 3").alias("task"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("c"), (k % 4).cast("string"))).alias("category"), F.concat(F.lit("message "), k.cast("string")).alias("message")).alias("log"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stack_id, i, pc, func, file, line, seq): made-up counters and files of the stacks' frames, by package."""
    f = table(spark, sf_dir, "stacks").select("stack_id", F.posexplode("funcs").alias("i", "func"))
    cls, package = package_class(F.col("func")), package_of(F.col("func"))
    file = F.when(cls.isin("runtime", "stdlib"), F.concat(F.lit("/usr/lib/go/src/"), package, F.lit("/a.go"))).when(cls == "main", "/work/app/main.go").otherwise(F.concat(F.lit("/home/u/pkg/mod/"), package, F.lit("@v1.2/b.go")))
    pc = (F.col("stack_id") % 50) * 1000 + F.col("i")
    return f.select("stack_id", "i", pc.cast("bigint").alias("pc"), "func", file.alias("file"), (F.col("i") + 10).cast("int").alias("line"), F.col("stack_id").alias("seq"))
