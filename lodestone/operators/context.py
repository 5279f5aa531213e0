"""From ranked candidates to a context: ranking, duplicates, caps, the token budget and the text itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.folds import ordered_fold

#: Weights of the eight features and the decay of graph proximity.
RANK_WEIGHTS = {
    "retrieval": 0.30, "entity": 0.25, "intent": 0.15, "relation": 0.10, "provenance": 0.10, "proximity": 0.05, "scope": 0.03, "locality": 0.02,
}
PROXIMITY_DECAY = 0.5
NEAR_JACCARD = 0.85


def rank_features(c: DataFrame) -> DataFrame:
    """Adds the feature columns that candidates and their query's plan decide.

    c: (query_id, candidate_id, retrieval_score, symbol_name, qualified_name, file_path, node_kind, relation, depth, n_sources,
    has_graph, target, asked_relation, intent, scope); relation and asked_relation are NONE where there is none.
    """

    def low(n: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(n), F.lit(""))))

    target, sym, q, path = low("target"), low("symbol_name"), low("qualified_name"), low("file_path")
    has = target != ""
    near = F.col("relation").isin("CALLS", "CALLERS", "DEPENDENCIES", "DEPENDENTS", "USES", "IMPORTS")
    linked = F.col("relation") != "NONE"
    intent = (
        F.when(F.col("intent").isin("DEPENDENCY", "EXPLANATION") & near, 1.0)
        .when((F.col("intent") == "IMPACT") & linked, 1.0)
        .when((F.col("intent") == "SYMBOL") & F.upper("node_kind").isin("FUNCTION", "METHOD", "CLASS", "INTERFACE"), 1.0)
        .when((F.col("intent") == "ARCHITECTURE") & F.upper("node_kind").isin("MODULE", "FILE", "PACKAGE", "CLASS"), 1.0)
        .otherwise(0.3)
    )
    asked, rel = F.col("asked_relation"), F.col("relation")
    complement = ((asked == "CALLERS") & (rel == "CALLS")) | ((asked == "CALLS") & (rel == "CALLERS")) | ((asked == "DEPENDENTS") & (rel == "DEPENDENCIES"))
    return c.withColumns(
        {
            "f_retrieval": 1 / (1 + F.exp(-F.coalesce("retrieval_score", F.lit(0.0)))),
            "f_entity": F.when(has & ((target == q) | (target == sym)), 1.0).when(has & path.contains(target), 0.8).when(has & (sym.contains(target) | q.contains(target)), 0.5).otherwise(0.0),
            "f_intent": intent,
            "f_relation": F.when(asked == "NONE", 0.5).when(asked == rel, 1.0).when(complement, 0.7).when(linked, 0.3).otherwise(0.0),
            "f_provenance": F.when(F.col("has_graph") & (F.col("n_sources") > 1), 1.0).when(F.col("n_sources") > 1, 0.9).when(F.col("has_graph"), 0.5).when(F.col("n_sources") == 1, 0.6).otherwise(0.3),
            "f_proximity": 1 / (1 + F.col("depth") * PROXIMITY_DECAY),
            "f_scope": F.when((F.col("scope") == "SYMBOL") & ((sym != "") | (q != "")), F.when(has & (sym == target), 1.0).otherwise(0.7)).when((F.col("scope") == "FILE") & (path != ""), 0.9).when(F.col("scope").isin("MODULE", "PACKAGE"), 0.8).otherwise(0.5),
            "f_locality": F.when(path == "", 0.0).when(has & path.contains(target), 1.0).otherwise(0.2),
        }
    )


def rank_context(c: DataFrame) -> DataFrame:
    """(query_id, candidate_id, context_score, context_rank): the weighted mean, ordered with a total tie-break."""
    score = sum(F.lit(w) * F.col(f"f_{n}") for n, w in RANK_WEIGHTS.items()) / sum(RANK_WEIGHTS.values())
    w = Window.partitionBy("query_id").orderBy(F.col("context_score").desc(), F.coalesce("retrieval_score", F.lit(0.0)).desc(), F.col("f_provenance").desc(), "depth", "relation", "candidate_id")
    return rank_features(c).withColumn("context_score", F.round(score, 6)).withColumn("context_rank", F.row_number().over(w)).select("query_id", "candidate_id", "context_score", "context_rank")


def duplicate_groups(c: DataFrame, near: float | None = None) -> DataFrame:
    """(query_id, candidate_id, survivor_id, reason): greedy stars in the order of rank, not transitive.

    In order, each candidate joins the first earlier survivor it matches, or survives itself: EXACT for the same file
    and lines or search result, LOGICAL for the same qualified name (trimmed, case ignored) or node, NEAR (with near, a
    least Jaccard similarity, of name parts and place within one file). A null or empty key, and the node unknown,
    matches nothing. Earlier survivors are found by
    their keys, so a query is streamed; only near looks through the survivors of the same file.

    c: (query_id, candidate_id, rank, file_path, start_line, end_line, symbol_name, qualified_name, node_kind) and, where
    it has them, chunk_id and node_id. With the rank of prune_order() a survivor is the best of its group.
    """

    def start() -> dict:
        return {"n": 0, "place": {}, "chunk": {}, "name": {}, "node": {}, "file": {}}

    def known(v) -> bool:
        return v is not None and not (isinstance(v, float) and pd.isna(v))

    def step(s: dict, r: dict) -> dict:
        place = (r["file_path"], r["start_line"], r["end_line"]) if all(known(r[k]) for k in ("file_path", "start_line", "end_line")) else None
        name = r["qualified_name"].strip().lower() if known(r["qualified_name"]) and r["qualified_name"].strip() else None
        low = [r[k].lower() for k in ("symbol_name", "node_kind") if known(r[k]) and r[k]]
        traits = frozenset([*low, *([f"lines:{r['start_line']}-{r['end_line']}"] if known(r["start_line"]) and known(r["end_line"]) else ()), *(name.split(".") if name else ())])
        chunk, node = r.get("chunk_id") or None, r.get("node_id") or None
        keys = {"place": (place, "EXACT"), "chunk": (chunk, "EXACT"), "name": (name, "LOGICAL"), "node": (None if node == "unknown" else node, "LOGICAL")}
        hits = [(*s[k][v], why) for k, (v, why) in keys.items() if v is not None and v in s[k]]
        if near is not None and known(r["file_path"]):
            for n, who, other in s["file"].get(r["file_path"], ()):
                if traits and other and len(traits & other) >= near * len(traits | other):
                    hits.append((n, who, "NEAR"))
                    break
        if hits:
            _, who, why = min(hits, key=lambda h: (h[0], h[2] == "NEAR", h[2]))
            return {"survivor_id": who, "reason": why}
        s["n"] += 1
        me = (s["n"], r["candidate_id"])
        for k, (v, _) in keys.items():
            if v is not None:
                s[k].setdefault(v, me)
        if near is not None and known(r["file_path"]):
            s["file"].setdefault(r["file_path"], []).append((*me, traits))
        return {"survivor_id": r["candidate_id"], "reason": None}

    order = [F.col("rank"), F.col("candidate_id")]
    return ordered_fold(c, "query_id", order, start, step, "survivor_id string, reason string").select("query_id", "candidate_id", "survivor_id", "reason")


def prune_order(c: DataFrame) -> DataFrame:
    """c with rank: by score (6 places), provenance, retrieval score, depth, relation, id; provenance comes before the retrieval score here.

    c: (query_id, candidate_id, final_score, f_provenance, retrieval_score, depth, relation).
    """
    w = Window.partitionBy("query_id").orderBy(
        F.round("final_score", 6).desc_nulls_last(), F.col("f_provenance").desc_nulls_last(), F.coalesce("retrieval_score", F.lit(0.0)).desc(), F.coalesce("depth", F.lit(0)), F.coalesce("relation", F.lit("NONE")), "candidate_id"
    )
    return c.withColumn("rank", F.row_number().over(w))


def merge_groups(c: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, candidate_id, n_merged, merged_ids, reason_codes, source, reason, <features>): one row a survivor.

    c: (query_id, candidate_id, rank, qualified_name, source, reason_codes array, f_* features); groups: of
    duplicate_groups(). Each feature is the group's greatest; reason codes are united, with MULTI_SOURCE_EVIDENCE where
    search and graph both found the group, whose provenance then is 1. reason is that of the last candidate merged:
    LOGICAL for the survivor's qualified name, else NEAR; null where nothing was merged.
    """
    features = [n for n in c.columns if n.startswith("f_")]
    rows = c.join(groups.select("query_id", "candidate_id", "survivor_id"), ["query_id", "candidate_id"])
    own = F.col("candidate_id") == F.col("survivor_id")
    got = rows.groupBy("query_id", "survivor_id").agg(
        F.count("*").alias("n_merged"), F.array_sort(F.collect_set("candidate_id")).alias("merged_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("reason_codes", F.array().cast("array<string>")))))).alias("codes"),
        F.bool_or(F.coalesce(F.col("source").contains("RETRIEVAL"), F.lit(False))).alias("r"), F.bool_or(F.coalesce(F.col("source").contains("GRAPH"), F.lit(False))).alias("g"),
        F.max(F.when(own, F.col("source"))).alias("own_source"), F.max(F.when(own, F.coalesce("qualified_name", F.lit("")))).alias("q"),
        F.max_by(F.when(~own, F.coalesce("qualified_name", F.lit(""))), F.when(~own, F.col("rank"))).alias("last_q"), *[F.max(f).alias(f) for f in features],
    )
    both = F.col("r") & F.col("g")
    out = got.select(
        "query_id", F.col("survivor_id").alias("candidate_id"), "n_merged", "merged_ids",
        F.when(both & (F.col("n_merged") > 1), F.array_sort(F.array_union("codes", F.array(F.lit("MULTI_SOURCE_EVIDENCE"))))).otherwise(F.col("codes")).alias("reason_codes"),
        F.when(F.col("n_merged") == 1, F.col("own_source")).when(both, "RETRIEVAL+GRAPH_EXPANSION").when(F.col("r"), "RETRIEVAL").when(F.col("g"), "GRAPH_EXPANSION").otherwise(F.col("own_source")).alias("source"),
        F.when(F.col("n_merged") > 1, F.when((F.col("q") != "") & (F.col("q") == F.col("last_q")), "LOGICAL").otherwise("NEAR")).alias("reason"),
        *[F.when(both & (F.col("n_merged") > 1), F.greatest(f, F.lit(1.0))).otherwise(F.col(f)).alias(f) if f == "f_provenance" else F.col(f) for f in features],
    )
    return out


#: The reason of each feature, and how much of it is needed.
REASONS = (
    ("DIRECT_QUERY_TARGET", "f_entity", 1.0), ("PRIMARY_INTENT_MATCH", "f_intent", 0.8), ("RELATIONSHIP_MATCH", "f_relation", 0.8), ("MULTI_SOURCE_EVIDENCE", "f_provenance", 0.9),
)


def reason_codes() -> Column:
    """The sorted reasons that rank_features() gives a candidate; SUPPORTING_CONTEXT where there is none."""
    found = F.filter(F.array(*[F.when(F.col(f) >= least, F.lit(name)) for name, f, least in REASONS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("SUPPORTING_CONTEXT")))


def protected(codes: Column, source: Column, targets: bool = True, multi_source: bool = True, structure: bool = True) -> Column:
    """Whether pruning must keep a candidate, by its reasons and where it was found."""
    out = F.lit(False)
    if targets:
        out = out | F.array_contains(codes, "DIRECT_QUERY_TARGET")
    if multi_source:
        out = out | (source == "RETRIEVAL+GRAPH_EXPANSION") | F.array_contains(codes, "MULTI_SOURCE_EVIDENCE")
    if structure:
        out = out | F.array_contains(codes, "RELATIONSHIP_MATCH") | F.array_contains(codes, "PRIMARY_INTENT_MATCH")
    return F.coalesce(out, F.lit(False))


def prune(c: DataFrame, least: float = 0.0, per_symbol: int | None = 2, per_file: int | None = 3, most: int | None = 10) -> DataFrame:
    """(query_id, candidate_id, decision): KEPT or the reason; caps count only what was kept before, in order of rank.

    c: (query_id, candidate_id, rank, final_score, symbol_name, file_path, protected). Protected rows pass every cap,
    and count in it. A null score is below any least.
    """

    def start() -> dict:
        return {"symbol": {}, "file": {}, "n": 0}

    def step(s: dict, r: dict) -> dict:
        safe, score = bool(r["protected"]), r["final_score"]
        if not safe:
            if score is None or pd.isna(score) or score < least:
                return {"decision": "BELOW_SCORE"}
            if per_symbol is not None and r["symbol_name"] and s["symbol"].get(r["symbol_name"], 0) >= per_symbol:
                return {"decision": "SYMBOL_CAP"}
            if per_file is not None and r["file_path"] and s["file"].get(r["file_path"], 0) >= per_file:
                return {"decision": "FILE_CAP"}
        for k in ("symbol_name", "file_path"):
            if r[k]:
                counts = s[k.split("_")[0]]
                counts[r[k]] = counts.get(r[k], 0) + 1
        s["n"] += 1
        return {"decision": "KEPT" if most is None or s["n"] <= most or safe else "TOP_K"}

    return ordered_fold(c, "query_id", [F.col("rank"), F.col("candidate_id")], start, step, "decision string").select("query_id", "candidate_id", "decision")


def pack_budget(c: DataFrame) -> DataFrame:
    """(query_id, candidate_id, decision, used): what fits into each query's budget, in order of rank.

    c: (query_id, candidate_id, rank, tokens, budget). An item too large for what is left is skipped and later ones are
    still tried, so this is no running sum. used: the tokens in the context after the row. Null sizes and budgets and
    negative sizes are skipped.
    """

    def start() -> dict:
        return {"used": 0}

    def step(s: dict, r: dict) -> dict:
        t, b = r["tokens"], r["budget"]
        ok = not (pd.isna(t) or pd.isna(b)) and 0 <= t <= b - s["used"]
        if ok:
            s["used"] += int(t)
        return {"decision": "INCLUDED" if ok else "OMITTED", "used": s["used"]}

    return ordered_fold(c, "query_id", [F.col("rank"), F.col("candidate_id")], start, step, "decision string, used bigint").select("query_id", "candidate_id", "decision", "used")


LEAST_CODE = 10


def pack_context(c: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """(query_id, candidate_id, decision, tokens, kept_lines, used): the packer with its limits, reasons and truncation.

    c: (query_id, candidate_id, rank, header_tokens, line_tokens array<int>, budget, policy). In order of rank: an item
    below least is omitted as BELOW_MINIMUM, one above most as CANDIDATE_TOO_LARGE; one that fits is INCLUDED. Of
    another, under the policy TRUNCATE and with more room than its header and LEAST_CODE tokens, the first lines that fit
    are kept (TRUNCATED), none of them if the first is too long. Else it is omitted: BUDGET_EXHAUSTED with nothing left,
    CANDIDATE_TOO_LARGE above the whole budget, TOKEN_BUDGET_EXCEEDED otherwise. Later items are still tried. tokens: what
    the item takes. Null sizes count as 0, a null budget as 0.
    """

    def start() -> dict:
        return {"used": 0}

    def number(v) -> int:
        return 0 if v is None or pd.isna(v) else int(v)

    def step(s: dict, r: dict) -> dict:
        head, budget = number(r["header_tokens"]), number(r["budget"])
        lines = [number(x) for x in (r["line_tokens"] if r["line_tokens"] is not None else ())]
        total, left, kept = head + sum(lines), budget - s["used"], len(lines)
        if least is not None and total < least:
            decision, take, kept = "BELOW_MINIMUM", 0, 0
        elif most is not None and total > most:
            decision, take, kept = "CANDIDATE_TOO_LARGE", 0, 0
        elif total <= left:
            decision, take = "INCLUDED", total
        elif r["policy"] == "TRUNCATE" and left > head + LEAST_CODE:
            decision, take, kept = "TRUNCATED", head, 0
            for x in lines:
                if take + x > left:
                    break
                take, kept = take + x, kept + 1
        else:
            decision, take, kept = "BUDGET_EXHAUSTED" if left <= 0 else "CANDIDATE_TOO_LARGE" if total > budget else "TOKEN_BUDGET_EXCEEDED", 0, 0
        s["used"] += take
        return {"decision": decision, "tokens": take, "kept_lines": kept, "used": s["used"]}

    out = "decision string, tokens bigint, kept_lines int, used bigint"
    return ordered_fold(c, "query_id", [F.col("rank"), F.col("candidate_id")], start, step, out).select("query_id", "candidate_id", "decision", "tokens", "kept_lines", "used")


def packing_stats(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(query_id, n_input, n_packed, n_truncated, n_omitted, tokens, remaining, utilisation) of pack_context(); budgets: (query_id, budget)."""
    inside = F.col("decision").isin("INCLUDED", "TRUNCATED")
    got = packed.groupBy("query_id").agg(F.count("*").alias("n_input"), F.count_if(inside).alias("n_packed"), F.count_if(F.col("decision") == "TRUNCATED").alias("n_truncated"), F.count_if(~inside).alias("n_omitted"), F.sum("tokens").alias("tokens"))
    budget = F.coalesce("budget", F.lit(0)).cast("bigint")
    return got.join(budgets, "query_id", "left").select(
        "query_id", "n_input", "n_packed", "n_truncated", "n_omitted", "tokens", F.greatest(budget - F.col("tokens"), F.lit(0)).alias("remaining"),
        F.when(budget > 0, F.round(F.least(F.col("tokens") / budget, F.lit(1.0)), 6)).otherwise(0.0).alias("utilisation"),
    )


def formatted(item: dict[str, Column]) -> Column:
    """One context item as text: five header lines and the code in a fence. item: id, symbol, path, lines, language, code."""
    return F.concat_ws(
        "\n", F.concat(F.lit("[CTX:"), item["id"], F.lit("]")), F.concat(F.lit("Symbol: "), F.coalesce(item["symbol"], F.lit("-"))), F.concat(F.lit("File: "), F.coalesce(item["path"], F.lit("-"))),
        F.concat(F.lit("Lines: "), F.coalesce(item["lines"], F.lit("-"))), F.concat(F.lit("Language: "), F.coalesce(item["language"], F.lit("text"))),
        F.concat(F.lit("```"), F.coalesce(item["language"], F.lit(""))), F.coalesce(item["code"], F.lit("")), F.lit("```"),
    )
