"""Ignore rules, extension filters and portable paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import extension

# The extensions of code and of documents.
CODE_EXTENSIONS = [".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hh", ".hxx"]
DOC_EXTENSIONS = [".pdf", ".docx", ".md", ".markdown", ".txt"]
#: Roots of a registry that are matched by an expression.
ROOTS = 200


def _matches(name: Column, patterns: list[str], globs: list[str]) -> Column:
    hit = name.isin(patterns) if patterns else F.lit(False)
    for p in globs:
        hit = hit | name.rlike(fnmatch.translate(p).removesuffix(r"\Z").removesuffix(r"\z") + r"\z")  # \Z lets a final line end pass in Java
    return F.coalesce(hit, F.lit(False))


def ignored_file(path: Column, patterns: list[str]) -> Column:
    """The base name equals a pattern, or matches one that holds * or ?; other patterns are literal. Case counts."""
    return _matches(F.element_at(F.split(path, "/"), -1), patterns, [p for p in patterns if "*" in p or "?" in p])


def ignored_folder(path: Column, patterns: list[str]) -> Column:
    """A component of the folder, the ancestors included, equals or matches a pattern."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.coalesce(F.exists(parts, lambda p: _matches(p, patterns, patterns)), F.lit(False))


def wanted(files: DataFrame, path: str, extensions: list[str], files_ignored: list[str] = (), folders_ignored: list[str] = ()) -> DataFrame:
    """Files with a wanted extension that no rule ignores; the rules are tested first. Null paths are dropped."""
    keep = ~ignored_folder(F.col(path), list(folders_ignored)) & ~ignored_file(F.col(path), list(files_ignored)) & extension(F.col(path)).isin(extensions)
    return files.where(F.col(path).isNotNull() & keep)


def encode_paths(files: DataFrame, roots: DataFrame, path: str = "path", out: str = "portable") -> DataFrame:
    """out = /<root's name in small letters>/<path below the root> for the longest root that holds the path.

    The root itself becomes /<name>/. ; a path under no root stays as it is; /a/bc is not below /a/b.
    Roots (columns name, root) are a registry. One of at most ROOTS is sent to the workers and matched by
    an expression without a shuffle; beyond that the path's prefixes are joined with the roots. Null
    paths stay null.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(path), "/{2,}", "/"), "(?<=.)/$", "")
    clean = F.when(clean.rlike(r"(^|/)\.\.?(/|$)"), normalise(clean)).otherwise(clean)
    rows = files.withColumn("_rl_p", clean)
    named = roots.select(F.lower("name").alias("_rl_name"), F.regexp_replace("root", "(?<=.)/+$", "").alias("_rl_up")).where("_rl_up IS NOT NULL").groupBy("_rl_up").agg(F.min("_rl_name").alias("_rl_name"))
    few = named.limit(ROOTS + 1).collect()
    if len(few) <= ROOTS:
        best = F.lit(None).cast("struct<_rl_name:string,_rl_up:string>")
        for r in sorted(few, key=lambda r: len(r._rl_up)):  # the longest is asked first
            holds = (F.col("_rl_p") == r._rl_up) | F.startswith(F.col("_rl_p"), F.lit(r._rl_up.rstrip("/") + "/"))
            best = F.when(holds, F.struct(F.lit(r._rl_name).alias("_rl_name"), F.lit(r._rl_up).alias("_rl_up"))).otherwise(best)
        found = rows.withColumn("_rl_b", best)
    else:
        ups = F.expr("transform(sequence(1, size(split(_rl_p, '/'))), k -> concat_ws('/', slice(split(_rl_p, '/'), 1, k)))")
        paths = rows.select("_rl_p").distinct()
        near = paths.select("_rl_p", F.explode(ups).alias("_rl_up")).where("_rl_up <> ''").join(named, "_rl_up").groupBy("_rl_p").agg(F.max_by(F.struct("_rl_name", "_rl_up"), F.length("_rl_up")).alias("_rl_b"))
        found = rows.join(near, "_rl_p", "left")
    rest = F.substring(F.col("_rl_p"), F.length("_rl_b._rl_up") + 2, F.length("_rl_p"))
    coded = F.concat(F.lit("/"), F.col("_rl_b._rl_name"), F.lit("/"), F.when(rest == "", ".").otherwise(rest))
    return found.withColumn(out, F.when(F.col("_rl_b").isNotNull(), coded).otherwise(F.col(path))).drop("_rl_p", "_rl_b")


def normalise(path: Column) -> Column:
    """Without . and .. components."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 1)
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(part.isin(".", ".."), acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(path, "/")
    return F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, F.lit(1), F.lit(1)), step), "/")


def collection_types(rows: DataFrame, registry: DataFrame, collection: str = "collection", out: str = "collection_type") -> DataFrame:
    """The registry's type of each collection, without regard to case and outer blanks; UNKNOWN if it has none."""
    types = registry.groupBy(F.upper(F.trim("name")).alias("_rl_n")).agg(F.max("rag_type").alias("_rl_t"))
    return rows.withColumn("_rl_n", F.upper(F.trim(F.col(collection)))).join(types, "_rl_n", "left").withColumn(out, F.coalesce("_rl_t", F.lit("UNKNOWN"))).drop("_rl_n", "_rl_t")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; ties keep one, null keys are one key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_rl_rn", F.row_number().over(w)).where("_rl_rn = 1").drop("_rl_rn")
