"""The dictionary of program counters, and where source files lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_dictionary(frames: DataFrame) -> DataFrame:
    """(pc, func, file, line), each counter once; of several entries the last by `seq` counts."""
    one = frames.where("pc is not null").groupBy("pc").agg(F.max_by(F.struct("func", "file", "line"), "seq").alias("f"))
    return one.select("pc", "f.func", "f.file", "f.line")


def resolve(stacks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(stack_id, frames): frames as structs (func, file, line), leaf first. `stacks` has stack_id and pcs.

    Repeated stacks count once; a counter that is not listed gives nulls.
    """
    at = stacks.dropDuplicates(["stack_id"]).select("stack_id", F.posexplode("pcs").alias("i", "pc"))
    j = at.join(dictionary, "pc", "left").groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("i", "func", "file", "line"))).alias("f"))
    return j.select("stack_id", F.transform("f", lambda x: F.struct(x["func"].alias("func"), x["file"].alias("file"), x["line"].alias("line"))).alias("frames"))


def located_text(frames: Column, limit: int | None = None) -> Column:
    """'func' and, indented below it, 'file:line' of each frame; the middle of more than `limit` frames (2 at least) is hidden."""
    lines = F.transform(frames, lambda f: F.concat(f["func"], F.lit("\n        "), f["file"], F.lit(":"), f["line"].cast("string")))
    if limit is None:
        return F.array_join(lines, "\n")
    limit = max(limit, 2)
    n = F.size(lines)
    hidden = F.array(F.concat(F.lit("["), (n - limit).cast("string"), F.lit(" frames hidden]")))
    return F.array_join(F.when(n > limit, F.concat(F.slice(lines, 1, limit - limit // 2), hidden, F.slice(lines, -(limit // 2), limit // 2))).otherwise(lines), "\n")


def _before_last(where: str, needle: str) -> str:
    """SQL: what stands before the last place of needle in where; null if it is not there."""
    return f"case when contains({where}, {needle}) then left({where}, cast(length({where}) - length({needle}) - length(substring_index({where}, {needle}, -1)) as int)) end"


def go_root(frames: DataFrame) -> DataFrame:
    """One row, goroot: up to the 'go' of go/src/runtime in a file of the runtime's own functions, '' if there is none.

    Where they disagree the smallest is taken.
    """
    own = frames.where("startswith(func, 'runtime.') and length(func) - length(replace(func, '.', '')) = 1 and not contains(func, '/') and contains(file, 'go/src/runtime')")
    return own.agg(F.coalesce(F.min(F.expr(f"{_before_last('file', chr(39) + 'go/src/runtime' + chr(39))} || 'go'")), F.lit("")).alias("goroot"))


def go_path(frames: DataFrame, goroot: Column) -> DataFrame:
    """One row, gopath: the most frequent prefix before src/<dir>/<package> or pkg/mod/<dir> of files outside goroot.

    '' if there is none or goroot is not known; of equals the smallest.
    """
    rows = frames.select("func", "file", goroot.alias("_root")).where("_root <> '' and not startswith(file, _root) and contains(func, '/')")
    rows = rows.withColumns({"_dir": F.expr("substring_index(func, '/', 1)"), "_pkg": F.expr("substring_index(substr(func, instr(func, '/') + 1), '.', 1)")})
    rows = rows.withColumns({"_a": F.expr("'src/' || _dir || '/' || _pkg"), "_b": F.expr("'pkg/mod/' || _dir")})
    prefix = F.expr(f"coalesce({_before_last('file', '_a')}, {_before_last('file', '_b')})")
    votes = rows.select(prefix.alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"))
    return votes.agg(F.coalesce(F.min_by("prefix", F.struct(-F.col("n"), "prefix")), F.lit("")).alias("gopath"))


def display_path(file: Column, goroot: Column, gopath: Column) -> Column:
    """A file's path with $GOROOT or $GOPATH for what is known; trimmed paths are told by the dot in their first part."""
    under = lambda name, prefix: F.concat(F.lit(f"${name}/"), F.ltrim(F.substring(file, F.length(prefix) + 1, F.length(file)), F.lit("/")))
    first = F.substring_index(file, "/", 1)
    trimmed = F.when(~F.contains(first, F.lit(".")), F.concat(F.lit("$GOROOT/src/"), file)).when(F.contains(file, F.lit("@v")), F.concat(F.lit("$GOPATH/pkg/mod/"), file)).otherwise(F.concat(F.lit("$GOPATH/src/"), file))
    return (
        F.when((goroot != "") & F.startswith(file, goroot), under("GOROOT", goroot)).when((gopath != "") & F.startswith(file, gopath), under("GOPATH", gopath))
        .when((goroot == "") & (gopath == "") & F.contains(file, F.lit("/")), trimmed).otherwise(file)
    )
