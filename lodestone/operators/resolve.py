"""Reference resolution: a cascade of joins against the symbol table, the first step with candidates decides.

The symbol table is aggregated once per lookup key to (number of candidates, smallest id), so a name borne by many
symbols is one row of the join and no list grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_name
from lodestone.session import cut_lineage

# Names that each language brings along.
BUILTINS = {
    "python": (
        "int str float bool bytes list dict set tuple None True False object type Exception ValueError TypeError RuntimeError AttributeError KeyError IndexError "
        "NotImplementedError StopIteration len range print input open isinstance issubclass hasattr getattr setattr super zip map filter sorted enumerate any all min "
        "max sum abs round"
    ).split(),
    "java": (
        "int long short byte float double boolean char void String Object Integer Long Boolean Double Float Number Comparable Iterable Override Deprecated "
        "SuppressWarnings"
    ).split(),
    "typescript": (
        "string number boolean void null undefined any unknown never object symbol bigint Array Map Set Promise Record Partial Required Readonly Pick Omit Error Date "
        "RegExp Function console JSON Math"
    ).split(),
}
#: The kind of symbol that a kind of reference looks for, and the confidence of each step.
KIND_HINTS = {"extends": "class", "implements": "interface", "call": "method", "type_usage": "class"}
CONFIDENCE = {"preset": 1.0, "exact": 1.0, "alias": 0.9, "method": 0.85, "file": 0.75, "repository": 0.6, "suffix": 0.5}


def symbols(nodes: DataFrame) -> DataFrame:
    """The symbol table of graph.entity_nodes(): (symbol_id, repository_id, file_id, kind, name, qualified_name, owner)."""
    rows = nodes.where(F.col("kind").isin("class", "interface", "function", "method", "variable"))
    owners = nodes.select(F.col("node_id").alias("parent_id"), F.col("name").alias("owner"))
    return rows.join(owners, "parent_id", "left").select(F.col("node_id").alias("symbol_id"), "repository_id", "file_id", "kind", "name", "qualified_name", "owner")


def aliases(refs: DataFrame) -> DataFrame:
    """(file_id, alias, expanded) of import references: the last segment stands for the whole; the last reference wins."""
    t = norm_name("target_qualified_name")
    return (
        refs.where(F.lower(F.trim("ref_kind")) == "import")
        .select(norm_id("source_file_id").alias("file_id"), F.element_at(F.split(t, r"\."), -1).alias("alias"), t.alias("expanded"), norm_id("reference_id").alias("id"))
        .where("file_id is not null and alias is not null")
        .groupBy("file_id", "alias")
        .agg(F.max(F.struct("id", "expanded")).alias("r"))
        .select("file_id", "alias", "r.expanded")
    )


def _lookup(table: DataFrame, keys: dict[str, Column], step: str) -> DataFrame:
    named = table.select(*[c.alias(k) for k, c in keys.items()], "symbol_id").where(" and ".join(f"{k} is not null" for k in keys))
    return named.groupBy(*keys).agg(F.count_distinct("symbol_id").alias(f"n_{step}"), F.min("symbol_id").alias(f"id_{step}"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference_id, step, status, symbol_id, n_candidates, confidence) of every reference that is no import.

    Steps: preset id in the repository, builtin of the file's language (the whole target or its last segment), exact
    qualified name, import alias of the first segment, method on a type by name, simple name in the file, simple name
    in the repository, qualified names that end in the last segment whatever stands before (case ignored). A step
    with one candidate resolves, with more it is ambiguous and the cascade ends; none left is unresolved. The simple
    and suffix steps look for the kind that the reference hints at, if any. Repeated references count once.
    """
    table = cut_lineage(symbols(nodes))
    langs = nodes.where("file_id is not null").groupBy("file_id").agg(F.min("language").alias("language"))
    hints = F.create_map(*[F.lit(x) for p in KIND_HINTS.items() for x in p])
    r = (
        refs.where(F.lower(F.trim("ref_kind")) != "import")
        .select(
            norm_id("reference_id").alias("reference_id"), norm_id("repository_id").alias("repository_id"), norm_id("source_file_id").alias("file_id"),
            F.lower(F.trim("ref_kind")).alias("ref_kind"), norm_name("target_qualified_name").alias("target"), norm_id("target_symbol_id").alias("preset"),
        )
        .where("reference_id is not null and target is not null")
        .groupBy("reference_id").agg(F.min(F.struct("repository_id", "file_id", "ref_kind", "target", "preset")).alias("r")).select("reference_id", "r.*")
        .join(langs, "file_id", "left")
        .withColumn("parts", F.split("target", r"\."))
        .withColumn("simple", F.element_at("parts", -1))
        .withColumn("hint", F.coalesce(hints[F.col("ref_kind")], F.lit("")))
        .withColumn("type_name", F.when(F.size("parts") > 1, F.element_at("parts", -2)))
        .withColumn("alias", F.element_at("parts", 1))
    )
    r = r.join(aliases(refs), ["file_id", "alias"], "left").withColumn(
        "expanded", F.when(F.col("expanded").isNotNull(), F.concat_ws(".", "expanded", F.nullif(F.array_join(F.slice("parts", 2, 1000), "."), F.lit(""))))
    )
    repo, name, kind = F.col("repository_id"), F.col("name"), F.col("kind")
    # A hint looks for one kind, no hint for any: the table holds each symbol under both.
    hinted = table.withColumn("hint", F.explode(F.array(kind, F.lit(""))))
    r = cut_lineage(
        r.join(_lookup(table, {"repository_id": repo, "preset": F.col("symbol_id")}, "preset"), ["repository_id", "preset"], "left")
        .join(_lookup(table, {"repository_id": repo, "target": F.col("qualified_name")}, "exact"), ["repository_id", "target"], "left")
        .join(_lookup(table, {"repository_id": repo, "expanded": F.col("qualified_name")}, "alias"), ["repository_id", "expanded"], "left")
        .join(_lookup(table.where("kind in ('method', 'function')"), {"repository_id": repo, "type_name": F.col("owner"), "simple": name}, "method"), ["repository_id", "type_name", "simple"], "left")
        .join(_lookup(hinted, {"file_id": F.col("file_id"), "simple": name, "hint": F.col("hint")}, "file"), ["file_id", "simple", "hint"], "left")
        .join(_lookup(hinted, {"repository_id": repo, "simple": name, "hint": F.col("hint")}, "repository"), ["repository_id", "simple", "hint"], "left")
    )
    builtin = F.lit(False)
    for lang, names in BUILTINS.items():
        builtin = builtin | ((F.col("language") == lang) & (F.col("target").isin(names) | F.col("simple").isin(names)))
    open_ = F.coalesce(*[F.col(f"n_{s}") for s in ("preset", "exact", "alias", "method", "file", "repository")]).isNull() & ~F.coalesce(builtin, F.lit(False))
    # A suffix of one of the lengths that are asked for: an equi-join in place of comparing every pair.
    asked = r.where(open_).select("repository_id", F.lower("simple").alias("suffix"), "hint").distinct()
    lengths = asked.select(F.length("suffix").alias("len")).distinct().agg(F.collect_set("len").alias("lens"))
    ends = hinted.where("qualified_name is not null").join(F.broadcast(lengths))  # one row, a number per length of a name
    ends = ends.select("repository_id", "hint", "symbol_id", F.explode(F.filter("lens", lambda n: n <= F.length("qualified_name"))).alias("n"), F.lower("qualified_name").alias("q"))
    ends = ends.select("repository_id", "hint", "symbol_id", F.expr("right(q, n)").alias("suffix")).join(asked, ["repository_id", "suffix", "hint"], "left_semi")
    r = r.withColumn("suffix", F.lower("simple")).join(_lookup(ends, {"repository_id": repo, "suffix": F.col("suffix"), "hint": F.col("hint")}, "suffix"), ["repository_id", "suffix", "hint"], "left")

    step = F.when(F.col("n_preset") > 0, "preset").when(builtin, "builtin")
    for s in ("exact", "alias", "method", "file", "repository", "suffix"):
        step = step.when(F.col(f"n_{s}") > 0, s)
    steps = [s for s in CONFIDENCE]
    n = F.coalesce(*[F.when(F.col("step") == s, F.col(f"n_{s}")) for s in steps], F.lit(0))
    first = F.coalesce(*[F.when(F.col("step") == s, F.col(f"id_{s}")) for s in steps])
    conf = F.coalesce(*[F.when(F.col("step") == s, F.lit(c)) for s, c in CONFIDENCE.items()], F.lit(0.0))
    out = r.withColumn("step", F.coalesce(step, F.lit("none"))).withColumn("n_candidates", n)
    one = F.col("n_candidates") == 1
    return out.select(
        "reference_id", "step",
        F.when(F.col("step") == "builtin", "BUILTIN").when(F.col("step") == "none", "UNRESOLVED").when(one, "RESOLVED").otherwise("AMBIGUOUS").alias("status"),
        F.when(one, first).alias("symbol_id"), "n_candidates", F.when(one, conf).otherwise(0.0).alias("confidence"),
    )


def resolve_imports(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference_id, status, symbol_id, n_members): import references by exact name, else as wildcard on a package.

    RESOLVED: one entity of the repository has the name. WILDCARD: none has, but n_members have it as their direct
    parent's name. EXTERNAL: no entity of the repository shares its first segment. UNRESOLVED: the rest.
    """
    r = (
        refs.where(F.lower(F.trim("ref_kind")) == "import")
        .select(norm_id("reference_id").alias("reference_id"), norm_id("repository_id").alias("repository_id"), F.regexp_replace(norm_name("target_qualified_name"), r"\.\*$", "").alias("target"))
        .where("reference_id is not null and target is not null")
        .groupBy("reference_id").agg(F.min(F.struct("repository_id", "target")).alias("r")).select("reference_id", "r.*")
    )
    n = nodes.where("qualified_name is not null and repository_id is not null")
    exact = n.groupBy("repository_id", F.col("qualified_name").alias("target")).agg(F.min("node_id").alias("symbol_id"))
    members = n.groupBy("repository_id", F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1).alias("target")).agg(F.count("*").alias("n_members"))
    firsts = n.select("repository_id", F.substring_index("qualified_name", ".", 1).alias("first")).distinct().withColumn("inside", F.lit(True))
    r = r.withColumn("first", F.substring_index("target", ".", 1))
    j = r.join(exact, ["repository_id", "target"], "left").join(members, ["repository_id", "target"], "left").join(firsts, ["repository_id", "first"], "left")
    status = F.when(F.col("symbol_id").isNotNull(), "RESOLVED").when(F.col("n_members").isNotNull(), "WILDCARD").when(F.col("inside").isNull(), "EXTERNAL").otherwise("UNRESOLVED")
    return j.select("reference_id", status.alias("status"), "symbol_id", F.coalesce("n_members", F.lit(0)).alias("n_members"))
