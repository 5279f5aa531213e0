"""Queries on contexts, questions, chunks and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_path
from lodestone.functions.text import claims, estimated_tokens, hash_embedding, identifiers, language_of, module_of, uuid5
from lodestone.operators import changes, chunking, context, graph, grounding, questions
from lodestone.operators.snapshots import snapshot_changes
from lodestone.plans.core_problems import _CHANGES
from lodestone.session import cut_lineage, table
from lodestone.sources import parsing

EARLY, LATE = "2025-05-01", "2025-08-01"


def _items(spark: SparkSession, d: str) -> DataFrame:
    cols = ["config_id", "rank", "final_score", "file_path", "start_line", "end_line", "symbol_name", "qualified_name", "node_kind", "source", "code_tokens", "header_tokens", "token_count"]
    r = table(spark, d, "packed_items").select(norm_id("query_id").alias("query_id"), norm_id("candidate_id").alias("candidate_id"), F.struct("packed_at", *cols).alias("r"))
    return r.groupBy("query_id", "candidate_id").agg(F.max("r").alias("r")).select("query_id", "candidate_id", *[f"r.{c}" for c in cols]).withColumn("tokens", F.coalesce("token_count", F.col("code_tokens") + F.col("header_tokens")))


def context_ranking(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    top = i.where("rank = 1").groupBy("query_id").agg(F.min("symbol_name").alias("target"))
    c = i.join(top, "query_id", "left").select(
        "query_id", "candidate_id", F.col("final_score").alias("retrieval_score"), "symbol_name", "qualified_name", "file_path", "node_kind", F.lit("NONE").alias("relation"), F.lit(0).alias("depth"),
        F.lit(1).alias("n_sources"), (F.col("source") == "graph").alias("has_graph"), "target", F.lit("NONE").alias("asked_relation"), F.lit("SYMBOL").alias("intent"), F.lit("SYMBOL").alias("scope"),
    )
    return context.rank_context(c)


def context_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return context.duplicate_groups(_items(spark, d).select("query_id", "candidate_id", "rank", "file_path", "start_line", "end_line", "symbol_name", "qualified_name", "node_kind"))


def context_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return context.duplicate_groups(_items(spark, d).select("query_id", "candidate_id", "rank", "file_path", "start_line", "end_line", "symbol_name", "qualified_name", "node_kind"), context.NEAR_JACCARD)


def context_pruning(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d).select("query_id", "candidate_id", "rank", "final_score", "symbol_name", "file_path", (F.col("rank") == 1).alias("protected"))
    return context.prune(i, 0.1)


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "budget_configs")
    reserves = sum(F.coalesce(F.col(r), F.lit(0)) for r in ("reserved_system_tokens", "reserved_query_tokens", "reserved_output_tokens", "safety_margin_tokens"))
    budget = c.groupBy("config_id").agg(F.max(F.greatest(F.lit(0), F.col("max_context_tokens") - reserves)).alias("budget"))
    return context.pack_budget(_items(spark, d).join(budget, "config_id", "left").select("query_id", "candidate_id", "rank", "tokens", "budget"))


def context_budget_report(spark: SparkSession, d: str) -> DataFrame:
    p = context_budget(spark, d)
    return p.groupBy("query_id").agg(F.count_if(F.col("decision") == "INCLUDED").alias("n_included"), F.count_if(F.col("decision") == "OMITTED").alias("n_omitted"), F.max("used").alias("used"))


def _with_budget(spark: SparkSession, d: str) -> DataFrame:
    """Items with budget and policy; an item's code tokens are spread over its lines, the rest over the first ones."""
    c = table(spark, d, "budget_configs")
    reserves = sum(F.coalesce(F.col(r), F.lit(0)) for r in ("reserved_system_tokens", "reserved_query_tokens", "reserved_output_tokens", "safety_margin_tokens"))
    b = c.groupBy("config_id").agg(F.max(F.greatest(F.lit(0), F.col("max_context_tokens") - reserves)).alias("budget"), F.max("overflow_policy").alias("policy"))
    n = F.greatest(F.lit(1), F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))
    code = F.coalesce("code_tokens", F.lit(0))
    lines = F.transform(F.sequence(F.lit(1), n), lambda i: F.floor(code / n).cast("int") + (i <= code % n).cast("int"))
    return _items(spark, d).join(b, "config_id", "left").select("query_id", "candidate_id", "rank", "header_tokens", lines.alias("line_tokens"), "budget", "policy")


def context_packing(spark: SparkSession, d: str) -> DataFrame:
    return context.pack_context(_with_budget(spark, d), 20, 4000)


def context_packing_stats(spark: SparkSession, d: str) -> DataFrame:
    i = cut_lineage(_with_budget(spark, d))
    return context.packing_stats(context.pack_context(i, 20, 4000), i.groupBy("query_id").agg(F.max("budget").alias("budget")))


_RELATIONS = ("NONE", "CALLS", "CALLERS", "DEPENDENCIES", "DEPENDENTS", "USES", "IMPORTS", "EXTENDS")
_INTENTS = ("SYMBOL", "DEPENDENCY", "IMPACT", "ARCHITECTURE", "EXPLANATION", "SEARCH")
_SCOPES = ("SYMBOL", "FILE", "MODULE", "PACKAGE", "REPOSITORY")


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose relation, depth, sources, intent and scope vary with rank and query, with their features and reasons."""
    i = _items(spark, d)
    top = i.where("rank = 1").groupBy("query_id").agg(F.min("symbol_name").alias("target"))
    q = F.conv(F.substring("query_id", 1, 4), 16, 10).cast("int")

    def pick(names: tuple[str, ...], k) -> F.Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))

    c = i.join(top, "query_id", "left").select(
        "query_id", "candidate_id", "rank", "final_score", F.col("final_score").alias("retrieval_score"), "symbol_name", "qualified_name", "file_path", "start_line", "end_line", "node_kind",
        pick(_RELATIONS, F.col("rank")).alias("relation"), (F.col("rank") % 4).cast("int").alias("depth"), (F.col("rank") % 3).alias("n_sources"), (F.col("rank") % 5 == 0).alias("has_graph"), "target",
        pick(_RELATIONS, q).alias("asked_relation"), pick(_INTENTS, q).alias("intent"), pick(_SCOPES, q).alias("scope"),
        F.when(F.col("rank") % 5 == 0, "GRAPH_EXPANSION").otherwise("RETRIEVAL").alias("source"),
    )
    return c


def context_ranking_varied(spark: SparkSession, d: str) -> DataFrame:
    return context.rank_context(_varied(spark, d).drop("rank", "final_score"))


def context_merged(spark: SparkSession, d: str) -> DataFrame:
    """Survivors of the duplicates in pruning order, with what their groups bring together."""
    f = context.prune_order(context.rank_features(_varied(spark, d)).withColumn("reason_codes", context.reason_codes()).drop("rank"))
    f = cut_lineage(f)
    g = context.duplicate_groups(f.select("query_id", "candidate_id", "rank", "file_path", "start_line", "end_line", "symbol_name", "qualified_name", "node_kind"), context.NEAR_JACCARD)
    m = context.merge_groups(f.select("query_id", "candidate_id", "rank", "qualified_name", "source", "reason_codes", *[n for n in f.columns if n.startswith("f_")]), g)
    return m.select("query_id", "candidate_id", "n_merged", F.concat_ws("+", "merged_ids").alias("merged_ids"), F.concat_ws("+", "reason_codes").alias("reason_codes"), "source", "reason", F.round("f_entity", 6).alias("entity"), F.round("f_provenance", 6).alias("provenance"), F.round("f_proximity", 6).alias("proximity"))


def context_texts(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    text = context.formatted({"id": F.col("candidate_id"), "symbol": F.col("symbol_name"), "path": F.col("file_path"), "lines": F.concat_ws("-", "start_line", "end_line"), "language": language_of("file_path"), "code": F.col("qualified_name")})
    return i.select("query_id", "candidate_id", text.alias("text"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every query's items as an answer that cites them, and as the contexts."""
    i = _items(spark, d).where("symbol_name is not null")
    said = F.concat(F.lit("The "), "symbol_name", F.lit(" of "), F.coalesce("qualified_name", F.lit("nothing")), F.lit(" is shown here"), F.when(F.col("rank") % 5 == 0, "").when(F.col("rank") % 7 == 0, " [CTX:none]").otherwise(F.concat(F.lit(" [CTX:"), "candidate_id", F.lit("]"))), F.lit("."))
    each = i.select("query_id", F.concat_ws(":", "query_id", "candidate_id").alias("answer_id"), said.alias("text"), F.col("candidate_id").alias("context_id"), "symbol_name", F.coalesce("qualified_name", F.lit("")).alias("code"))
    return each.select("answer_id", "text"), each.select("answer_id", "context_id", "symbol_name", "code")


def grounding_claims(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verify(*_answers(spark, d))


def grounding_summary(spark: SparkSession, d: str) -> DataFrame:
    return grounding.summary(grounding.verify(*_answers(spark, d)))


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lower(trim(source)) = 'answer_log'").select("doc_id", F.size(claims("text")).alias("n_claims"))


def question_plans(spark: SparkSession, d: str) -> DataFrame:
    return questions.understand(table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text"))


def question_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(identifiers("text")).alias("identifier"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", estimated_tokens("text").cast("bigint").alias("tokens"))


def path_modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select(norm_path("path").alias("path")).distinct().select("path", language_of("path").alias("language"), module_of("path").alias("module"), uuid5(chunking.NAMESPACE, F.col("path")).alias("id"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(hash_embedding(F.col("text"))).alias("place", "value")).select("doc_id", "place", F.round("value", 6).alias("value"))


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    return chunking.file_chunks(table(spark, d, "source_files")).select("file_id", "start_line", "end_line", F.md5("content").alias("digest"))


def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ir_entities")
    spans = e.groupBy(norm_id("entity_id").alias("node_id")).agg(F.min(F.struct("start_line", "end_line")).alias("r")).select("node_id", "r.*")
    nodes = graph.entity_nodes(e)
    signed = chunking.signatures(nodes, table(spark, d, "code_refs"), e.groupBy(norm_id("entity_id").alias("node_id")).agg(F.bool_or("is_async").alias("is_async")))
    c = chunking.entity_chunks(table(spark, d, "source_files"), nodes, spans, signed, 20)
    return c.select("entity_id", "chunk_type", "sub_index", "n_sub", "start_line", "end_line", "signature", F.md5("content").alias("digest"))


def parsed_entities(spark: SparkSession, d: str) -> DataFrame:
    """How many of the recorded declarations of each language and kind are parsed from the files' texts."""
    f = chunking.kept_files(table(spark, d, "source_files"))
    kind = F.when(F.col("kind") == "constructor", "method").when(F.col("kind") == "enum", "class").otherwise(F.col("kind"))
    found = parsing.parse_sources(f).where("row_kind = 'entity'").select("file_id", kind.alias("kind"), "qualified_name").distinct().withColumn("found", F.lit(True))
    known = graph.entity_nodes(table(spark, d, "ir_entities")).where("kind in ('class', 'interface', 'function', 'method') and qualified_name is not null")
    known = known.select("file_id", "kind", "qualified_name").distinct().join(f.select("file_id", "language"), "file_id")
    return known.join(found, ["file_id", "kind", "qualified_name"], "left").groupBy("language", "kind").agg(F.count("*").alias("n_recorded"), F.count("found").alias("n_parsed"))


def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered files replace what was there: one row an id, the latest."""
    return chunking.kept_files(table(spark, d, "source_files")).select("file_id", "path", F.size("lines").alias("n_lines"))


def symbol_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ir_entities")
    return changes.symbol_changes(changes.alive(e, EARLY), changes.alive(e, LATE))


def reindex_actions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ir_entities")
    old, new = (changes.alive(e, t).select(F.concat_ws("/", "repository_id", "qualified_name").alias("chunk_id"), F.lit("symbol").alias("chunk_type"), F.col("body").alias("text")) for t in (EARLY, LATE))
    return changes.reindex_plan(old, new)


def index_version(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ir_entities")
    old, new = changes.alive(e, EARLY), changes.alive(e, LATE)
    diff = cut_lineage(changes.symbol_changes(old, new))
    key = ["repository_id", "qualified_name"]
    base, fresh = (x.withColumn("key", F.concat_ws("/", *key)) for x in (old, new))
    gone = diff.where("change_type = 'DELETED'").select(F.concat_ws("/", *key).alias("key"))
    added = fresh.join(diff.where("change_type <> 'DELETED'").select(F.concat_ws("/", *key).alias("key")), "key", "left_semi")
    return changes.next_version(base, gone, added, "key").select("repository_id", "qualified_name", "symbol_id", "place")


def changed_files_audit(spark: SparkSession, d: str) -> DataFrame:
    derived = snapshot_changes(table(spark, d, "file_snapshots"), table(spark, d, "snapshot_deliveries"))
    logged = table(spark, d, "changed_files").select(norm_id("repository_id").alias("repository_id"), "snapshot_no", norm_path("path").alias("path"), F.upper(F.trim("change_type")).alias("change_type"))
    return changes.audit_log(derived, logged.where("repository_id is not null and snapshot_no is not null and path is not null and change_type is not null"))


QUERIES = {
    f.__name__: f
    for f in (
        context_ranking, context_duplicates, context_near_duplicates, context_pruning, context_budget, context_budget_report, context_packing, context_packing_stats, context_ranking_varied, context_merged, context_texts, grounding_claims, grounding_summary, answer_claims,
        question_plans, question_identifiers, token_estimates, path_modules, hash_embeddings, chunk_files, chunk_entities, parsed_entities, chunk_upsert, symbol_diff, reindex_actions, index_version, changed_files_audit,
    )
}

_ITEMS = """
it AS (
  SELECT *, coalesce(token_count, code_tokens + header_tokens) AS tokens FROM (
    SELECT lower(trim(query_id)) AS query_id, lower(trim(candidate_id)) AS candidate_id, * EXCLUDE (query_id, candidate_id),
      row_number() OVER (PARTITION BY lower(trim(query_id)), lower(trim(candidate_id)) ORDER BY packed_at DESC) AS rn FROM packed_items) WHERE rn = 1),
bud AS (SELECT config_id, greatest(0, max_context_tokens - coalesce(reserved_system_tokens, 0) - coalesce(reserved_query_tokens, 0) - coalesce(reserved_output_tokens, 0) - coalesce(safety_margin_tokens, 0)) AS budget
  FROM budget_configs),
o AS (SELECT it.*, budget, row_number() OVER (PARTITION BY query_id ORDER BY rank, candidate_id) AS at_row FROM it LEFT JOIN bud USING (config_id))
"""

_BUDGET = "WITH RECURSIVE " + _ITEMS + """,
f AS (
  SELECT query_id, candidate_id, at_row, coalesce(tokens >= 0 AND tokens <= budget, false) AS ok, CASE WHEN tokens >= 0 AND tokens <= budget THEN tokens ELSE 0 END::BIGINT AS used FROM o WHERE at_row = 1
  UNION ALL
  SELECT o.query_id, o.candidate_id, o.at_row, coalesce(o.tokens >= 0 AND o.tokens <= o.budget - f.used, false), f.used + CASE WHEN o.tokens >= 0 AND o.tokens <= o.budget - f.used THEN o.tokens ELSE 0 END
  FROM f JOIN o ON o.query_id = f.query_id AND o.at_row = f.at_row + 1)
"""

_PRUNE = "WITH RECURSIVE " + _ITEMS + """,
f AS (
  SELECT query_id, candidate_id, at_row, 'KEPT' AS decision, [symbol_name] AS syms, [file_path] AS files, 1 AS n FROM o WHERE at_row = 1 AND rank = 1
  UNION ALL
  SELECT query_id, candidate_id, at_row, CASE WHEN final_score IS NULL OR final_score < 0.1 THEN 'BELOW_SCORE' ELSE 'KEPT' END, CASE WHEN final_score >= 0.1 THEN [symbol_name] ELSE [] END,
    CASE WHEN final_score >= 0.1 THEN [file_path] ELSE [] END, CASE WHEN final_score >= 0.1 THEN 1 ELSE 0 END FROM o WHERE at_row = 1 AND rank <> 1
  UNION ALL
  SELECT query_id, candidate_id, at_row, d, CASE WHEN d IN ('KEPT', 'TOP_K') THEN list_append(syms, symbol_name) ELSE syms END, CASE WHEN d IN ('KEPT', 'TOP_K') THEN list_append(files, file_path) ELSE files END,
    CASE WHEN d IN ('KEPT', 'TOP_K') THEN n + 1 ELSE n END
  FROM (SELECT o.query_id, o.candidate_id, o.at_row, o.symbol_name, o.file_path, f.syms, f.files, f.n,
      CASE WHEN o.rank <> 1 AND (o.final_score IS NULL OR o.final_score < 0.1) THEN 'BELOW_SCORE'
           WHEN o.rank <> 1 AND o.symbol_name <> '' AND len(list_filter(f.syms, lambda x: x = o.symbol_name)) >= 2 THEN 'SYMBOL_CAP'
           WHEN o.rank <> 1 AND o.file_path <> '' AND len(list_filter(f.files, lambda x: x = o.file_path)) >= 3 THEN 'FILE_CAP'
           WHEN o.rank = 1 OR f.n < 10 THEN 'KEPT' ELSE 'TOP_K' END AS d
    FROM f JOIN o ON o.query_id = f.query_id AND o.at_row = f.at_row + 1))
"""


def _alive(at: str) -> str:
    return f"""SELECT repository_id, qualified_name, min({{'symbol_id': symbol_id, 'body': body, 'place': place}}) AS r FROM (
    SELECT lower(trim(entity_id)) AS symbol_id, min(lower(trim(repository_id))) AS repository_id, min(nullif(trim(qualified_name), '')) AS qualified_name, min(concat_ws('|', kind, name, doc_comment)) AS body,
      min(concat_ws('-', start_line, end_line)) AS place, min(indexed_at) AS since, CASE WHEN count(*) > count(deleted_at) THEN NULL ELSE max(deleted_at) END AS until FROM ir_entities GROUP BY 1)
  WHERE qualified_name IS NOT NULL AND since <= TIMESTAMP '{at}' AND (until IS NULL OR until > TIMESTAMP '{at}') GROUP BY 1, 2"""


_SYMBOLS = f"WITH a AS ({_alive(EARLY)}), b AS ({_alive(LATE)})"

_FILES = """
WITH k AS (
  SELECT lower(trim(file_id)) AS file_id, arg_max({'path': regexp_replace(replace(trim(path), chr(92), '/'), '^(\\./+)+', ''), 'content': content}, indexed_at) AS r FROM source_files WHERE content IS NOT NULL GROUP BY 1),
f AS (SELECT file_id, r.path AS path, replace(replace(r.content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM k),
l AS (SELECT file_id, path, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(t, '\\n$', ''), chr(10)) END AS lines FROM f)
"""

_PACK = "WITH RECURSIVE " + _ITEMS + """,
pol AS (SELECT config_id, max(overflow_policy) AS policy FROM budget_configs GROUP BY 1),
z AS (SELECT o.query_id, o.candidate_id, at_row, coalesce(header_tokens, 0) AS h, coalesce(code_tokens, 0) AS c, greatest(1, coalesce(end_line - start_line + 1, 1)) AS n, coalesce(budget, 0) AS b, policy FROM o LEFT JOIN pol USING (config_id)),
g AS (
  SELECT query_id, NULL::VARCHAR AS candidate_id, 0::BIGINT AS at_row, NULL::VARCHAR AS decision, 0::BIGINT AS tokens, 0::INTEGER AS kept_lines, 0::BIGINT AS used FROM (SELECT DISTINCT query_id FROM z)
  UNION ALL
  SELECT query_id, candidate_id, at_row, decision, t, k, used + t FROM (
    SELECT *, CASE decision WHEN 'INCLUDED' THEN h + c WHEN 'TRUNCATED' THEN h + k * (c // n) + least(k, c % n) ELSE 0 END::BIGINT AS t FROM (
      SELECT *, CASE decision WHEN 'INCLUDED' THEN n WHEN 'TRUNCATED' THEN len(list_filter(range(1, n + 1), lambda i: h + i * (c // n) + least(i, c % n) <= b - used)) ELSE 0 END::INTEGER AS k FROM (
        SELECT z.*, used, CASE WHEN h + c < 20 THEN 'BELOW_MINIMUM' WHEN h + c > 4000 THEN 'CANDIDATE_TOO_LARGE' WHEN h + c <= b - used THEN 'INCLUDED' WHEN policy = 'TRUNCATE' AND b - used > h + 10 THEN 'TRUNCATED'
          WHEN b - used <= 0 THEN 'BUDGET_EXHAUSTED' WHEN h + c > b THEN 'CANDIDATE_TOO_LARGE' ELSE 'TOKEN_BUDGET_EXCEEDED' END AS decision
        FROM g JOIN z ON z.query_id = g.query_id AND z.at_row = g.at_row + 1))))
"""

_VARIED = "WITH RECURSIVE " + _ITEMS + """,
tt AS (SELECT query_id, min(symbol_name) AS target FROM it WHERE rank = 1 GROUP BY 1),
va AS (SELECT it.query_id, candidate_id, final_score, coalesce(final_score, 0) AS s, symbol_name, qualified_name, file_path, start_line, end_line, node_kind, ['NONE', 'CALLS', 'CALLERS', 'DEPENDENCIES', 'DEPENDENTS', 'USES', 'IMPORTS', 'EXTENDS'] AS names,
  names[rank % 8 + 1] AS rel, rank % 4 AS depth, rank % 3 AS ns, rank % 5 = 0 AS gr, ('0x' || it.query_id[1:4])::INT AS qn, names[qn % 8 + 1] AS asked,
  ['SYMBOL', 'DEPENDENCY', 'IMPACT', 'ARCHITECTURE', 'EXPLANATION', 'SEARCH'][qn % 6 + 1] AS intent, ['SYMBOL', 'FILE', 'MODULE', 'PACKAGE', 'REPOSITORY'][qn % 5 + 1] AS scope,
  CASE WHEN rank % 5 = 0 THEN 'GRAPH_EXPANSION' ELSE 'RETRIEVAL' END AS src,
  lower(trim(coalesce(target, ''))) AS g, lower(trim(coalesce(symbol_name, ''))) AS sy, lower(trim(coalesce(qualified_name, ''))) AS q, lower(trim(coalesce(file_path, ''))) AS p, upper(node_kind) AS nk FROM it LEFT JOIN tt USING (query_id)),
fe AS (SELECT *, CASE WHEN g <> '' AND (g = q OR g = sy) THEN 1.0 WHEN g <> '' AND contains(p, g) THEN 0.8 WHEN g <> '' AND (contains(sy, g) OR contains(q, g)) THEN 0.5 ELSE 0 END::DOUBLE AS fe,
  CASE WHEN intent IN ('DEPENDENCY', 'EXPLANATION') AND rel IN ('CALLS', 'CALLERS', 'DEPENDENCIES', 'DEPENDENTS', 'USES', 'IMPORTS') THEN 1.0 WHEN intent = 'IMPACT' AND rel <> 'NONE' THEN 1.0
    WHEN intent = 'SYMBOL' AND nk IN ('FUNCTION', 'METHOD', 'CLASS', 'INTERFACE') THEN 1.0 WHEN intent = 'ARCHITECTURE' AND nk IN ('MODULE', 'FILE', 'PACKAGE', 'CLASS') THEN 1.0 ELSE 0.3 END::DOUBLE AS fi,
  CASE WHEN asked = 'NONE' THEN 0.5 WHEN asked = rel THEN 1.0 WHEN (asked, rel) IN (('CALLERS', 'CALLS'), ('CALLS', 'CALLERS'), ('DEPENDENTS', 'DEPENDENCIES')) THEN 0.7 WHEN rel <> 'NONE' THEN 0.3 ELSE 0 END::DOUBLE AS fr,
  CASE WHEN gr AND ns > 1 THEN 1.0 WHEN ns > 1 THEN 0.9 WHEN gr THEN 0.5 WHEN ns = 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS fp, 1 / (1 + depth * 0.5::DOUBLE) AS fx,
  CASE WHEN scope = 'SYMBOL' AND (sy <> '' OR q <> '') THEN CASE WHEN g <> '' AND sy = g THEN 1.0 ELSE 0.7 END WHEN scope = 'FILE' AND p <> '' THEN 0.9 WHEN scope IN ('MODULE', 'PACKAGE') THEN 0.8 ELSE 0.5 END::DOUBLE AS fs,
  CASE WHEN p = '' THEN 0 WHEN g <> '' AND contains(p, g) THEN 1.0 ELSE 0.2 END::DOUBLE AS fl FROM va),
cx AS (SELECT *, round(0.30::DOUBLE * (1 / (1 + exp(-s))) + 0.25::DOUBLE * fe + 0.15::DOUBLE * fi + 0.10::DOUBLE * fr + 0.10::DOUBLE * fp + 0.05::DOUBLE * fx + 0.03::DOUBLE * fs + 0.02::DOUBLE * fl, 6) AS sc FROM fe)
"""

_STAR = """
w AS (SELECT *, CASE WHEN file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL THEN file_path || chr(1) || start_line || '-' || end_line END AS place, nullif(lower(trim(qualified_name)), '') AS nm,
  list_distinct(list_filter(list_concat([nullif(lower(symbol_name), ''), nullif(lower(node_kind), ''), 'lines:' || start_line || '-' || end_line], coalesce(string_split(nullif(lower(trim(qualified_name)), ''), '.'), [])), lambda x: x IS NOT NULL)) AS tr FROM ORDERED),
f AS (
  SELECT query_id, 0::BIGINT AS at_row, NULL::VARCHAR AS candidate_id, NULL::VARCHAR AS survivor_id, NULL::VARCHAR AS reason, []::STRUCT(id VARCHAR, place VARCHAR, nm VARCHAR, fp VARCHAR, tr VARCHAR[])[] AS st FROM (SELECT DISTINCT query_id FROM w)
  UNION ALL
  SELECT query_id, at_row, candidate_id, coalesce(hit.id, candidate_id), CASE WHEN hit IS NULL THEN NULL WHEN hit.place = place THEN 'EXACT' WHEN hit.nm = nm THEN 'LOGICAL' ELSE 'NEAR' END,
    CASE WHEN hit IS NULL THEN list_append(st, {'id': candidate_id, 'place': place, 'nm': nm, 'fp': file_path, 'tr': tr}) ELSE st END
  FROM (SELECT w.*, f.st, list_filter(f.st, lambda x: coalesce(x.place = w.place, false) OR coalesce(x.nm = w.nm, false) OR (NEARBY))[1] AS hit FROM f JOIN w ON w.query_id = f.query_id AND w.at_row = f.at_row + 1))
"""
_NEARBY = "coalesce(x.fp = w.file_path, false) AND len(x.tr) > 0 AND len(w.tr) > 0 AND len(list_intersect(x.tr, w.tr)) >= 0.85 * len(list_distinct(list_concat(x.tr, w.tr)))"
_DUPLICATES = "WITH RECURSIVE " + _ITEMS + "," + _STAR.replace("ORDERED", "o") + "SELECT query_id, candidate_id, survivor_id, reason FROM f WHERE candidate_id IS NOT NULL"

SQL = {
    "context_duplicates": _DUPLICATES.replace("NEARBY", "false"),
    "context_near_duplicates": _DUPLICATES.replace("NEARBY", _NEARBY),
    "context_packing": _PACK + "SELECT query_id, candidate_id, decision, tokens, kept_lines, used FROM g WHERE candidate_id IS NOT NULL",
    "context_packing_stats": _PACK
    + """SELECT query_id, count(*) AS n_input, count(*) FILTER (decision IN ('INCLUDED', 'TRUNCATED')) AS n_packed, count(*) FILTER (decision = 'TRUNCATED') AS n_truncated, count(*) FILTER (decision NOT IN ('INCLUDED', 'TRUNCATED')) AS n_omitted,
  sum(tokens)::BIGINT AS tokens, greatest(0, max(b) - sum(tokens))::BIGINT AS remaining, CASE WHEN max(b) > 0 THEN round(least(1.0, sum(tokens) / max(b)), 6) ELSE 0 END::DOUBLE AS utilisation
FROM (SELECT g.*, z.b FROM g JOIN z USING (query_id, candidate_id)) GROUP BY 1""",
    "context_ranking_varied": _VARIED
    + "SELECT query_id, candidate_id, sc AS context_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, s DESC, fp DESC, depth, rel, candidate_id) AS INTEGER) AS context_rank FROM cx",
    "context_merged": _VARIED
    + """, po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 6) DESC NULLS LAST, fp DESC, s DESC, depth, rel, candidate_id) AS at_row,
  CASE WHEN fe >= 1 OR fi >= 0.8 OR fr >= 0.8 OR fp >= 0.9 THEN list_filter([CASE WHEN fe >= 1 THEN 'DIRECT_QUERY_TARGET' END, CASE WHEN fi >= 0.8 THEN 'PRIMARY_INTENT_MATCH' END, CASE WHEN fr >= 0.8 THEN 'RELATIONSHIP_MATCH' END,
    CASE WHEN fp >= 0.9 THEN 'MULTI_SOURCE_EVIDENCE' END], lambda x: x IS NOT NULL) ELSE ['SUPPORTING_CONTEXT'] END AS codes FROM cx),"""
    + _STAR.replace("ORDERED", "po").replace("NEARBY", _NEARBY)
    + """, gr AS (SELECT po.*, f.survivor_id, po.candidate_id = survivor_id AS own, coalesce(qualified_name, '') AS qn2 FROM f JOIN po USING (query_id, candidate_id)),
ag AS (SELECT query_id, survivor_id, count(*) AS n_merged, array_to_string(list_sort(list(candidate_id)), '+') AS merged_ids, list_distinct(flatten(list(codes))) AS codes, bool_or(src = 'RETRIEVAL') AS r, bool_or(src = 'GRAPH_EXPANSION') AS g,
  max(src) FILTER (own) AS own_src, max(qn2) FILTER (own) AS oq, arg_max(qn2, at_row) FILTER (NOT own) AS lq, max(fe) AS fe, max(fp) AS fp, max(fx) AS fx FROM gr GROUP BY 1, 2)
SELECT query_id, survivor_id AS candidate_id, n_merged, merged_ids, array_to_string(list_sort(CASE WHEN r AND g AND n_merged > 1 AND NOT list_contains(codes, 'MULTI_SOURCE_EVIDENCE') THEN list_append(codes, 'MULTI_SOURCE_EVIDENCE') ELSE codes END), '+') AS reason_codes,
  CASE WHEN n_merged = 1 THEN own_src WHEN r AND g THEN 'RETRIEVAL+GRAPH_EXPANSION' WHEN r THEN 'RETRIEVAL' ELSE 'GRAPH_EXPANSION' END AS source,
  CASE WHEN n_merged > 1 THEN CASE WHEN oq <> '' AND oq = lq THEN 'LOGICAL' ELSE 'NEAR' END END AS reason, round(fe, 6) AS entity, round(CASE WHEN r AND g AND n_merged > 1 THEN 1.0::DOUBLE ELSE fp END, 6) AS provenance, round(fx, 6) AS proximity FROM ag""",
    "context_ranking": "WITH " + _ITEMS
    + """, t AS (SELECT query_id, min(symbol_name) AS target FROM it WHERE rank = 1 GROUP BY 1),
x AS (SELECT it.query_id, candidate_id, coalesce(final_score, 0) AS s, lower(trim(coalesce(target, ''))) AS g, lower(trim(coalesce(symbol_name, ''))) AS sy, lower(trim(coalesce(qualified_name, ''))) AS q,
  lower(trim(coalesce(file_path, ''))) AS p, upper(node_kind) AS nk, coalesce(source = 'graph', false) AS gr FROM it LEFT JOIN t USING (query_id)),
y AS (SELECT *, (0.30 * (1 / (1 + exp(-s))) + 0.25 * CASE WHEN g <> '' AND (g = q OR g = sy) THEN 1.0 WHEN g <> '' AND contains(p, g) THEN 0.8 WHEN g <> '' AND (contains(sy, g) OR contains(q, g)) THEN 0.5 ELSE 0 END
  + 0.15 * CASE WHEN nk IN ('FUNCTION', 'METHOD', 'CLASS', 'INTERFACE') THEN 1.0 ELSE 0.3 END + 0.10 * 0.5 + 0.10 * CASE WHEN gr THEN 0.5 ELSE 0.6 END + 0.05
  + 0.03 * CASE WHEN sy <> '' OR q <> '' THEN CASE WHEN g <> '' AND sy = g THEN 1.0 ELSE 0.7 END ELSE 0.5 END
  + 0.02 * CASE WHEN p = '' THEN 0 WHEN g <> '' AND contains(p, g) THEN 1.0 ELSE 0.2 END) AS c, CASE WHEN gr THEN 0.5 ELSE 0.6 END AS pr FROM x)
SELECT query_id, candidate_id, round(c, 6)::DOUBLE AS context_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, s DESC, pr DESC, candidate_id) AS INTEGER) AS context_rank FROM y""",
    "context_pruning": _PRUNE + "SELECT query_id, candidate_id, decision FROM f",
    "context_budget": _BUDGET + "SELECT query_id, candidate_id, CASE WHEN ok THEN 'INCLUDED' ELSE 'OMITTED' END AS decision, used FROM f",
    "context_budget_report": _BUDGET + "SELECT query_id, count(*) FILTER (ok) AS n_included, count(*) FILTER (NOT ok) AS n_omitted, max(used) AS used FROM f GROUP BY 1",
    "context_texts": "WITH " + _ITEMS
    + """, x AS (SELECT *, CASE WHEN lower(file_path) LIKE '%.py' THEN 'python' WHEN lower(file_path) LIKE '%.java' THEN 'java' WHEN regexp_matches(lower(file_path), '\\.(ts|tsx|js|jsx)$') THEN 'typescript' END AS lang FROM it)
SELECT query_id, candidate_id, concat_ws(chr(10), '[CTX:' || candidate_id || ']', 'Symbol: ' || coalesce(symbol_name, '-'), 'File: ' || coalesce(file_path, '-'), 'Lines: ' || coalesce(concat_ws('-', start_line, end_line), '-'),
  'Language: ' || coalesce(lang, 'text'), '```' || coalesce(lang, ''), coalesce(qualified_name, ''), '```') AS text FROM x""",
    "answer_claims": """SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\.[ \\t\\r\\n\\f]+([A-Z])', '.' || chr(1) || '\\1', 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS INTEGER) AS n_claims
FROM documents WHERE lower(trim(source)) = 'answer_log'""",
    "token_estimates": """SELECT doc_id, CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0
  ELSE greatest(1, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')), ceil(length(text) / 4.0)) END AS BIGINT) AS tokens FROM documents""",
    "hash_embeddings": """
WITH h AS (SELECT doc_id, sha256('hash:1:' || coalesce(text, '')) AS h FROM documents),
r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: (('0x' || h[2 * (i % 32) + 1:2 * (i % 32) + 2])::INT * 256 + ('0x' || h[2 * ((7 * i + 13) % 32) + 1:2 * ((7 * i + 13) % 32) + 2])::INT) / 32767.5::DOUBLE - 1) AS r FROM h),
u AS (SELECT doc_id, r, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n FROM r)
SELECT doc_id, CAST(i AS INTEGER) AS place, round(r[i + 1] / n, 6) AS value FROM u, (SELECT unnest(range(0, 64)) AS i)""",
    "chunk_files": _FILES + "SELECT file_id, 1 AS start_line, CAST(least(len(lines), 150) AS INTEGER) AS end_line, md5(array_to_string(lines[1:150], chr(10))) AS digest FROM l",
    "chunk_upsert": _FILES + "SELECT file_id, path, CAST(len(lines) AS INTEGER) AS n_lines FROM l",
    "symbol_diff": _SYMBOLS
    + """, c AS (SELECT coalesce(a.repository_id, b.repository_id) AS repository_id, coalesce(a.qualified_name, b.qualified_name) AS qualified_name,
  CASE WHEN a.r IS NULL THEN 'ADDED' WHEN b.r IS NULL THEN 'DELETED' WHEN a.r.body <> b.r.body THEN 'MODIFIED' WHEN a.r.symbol_id <> b.r.symbol_id OR a.r.place <> b.r.place THEN 'IDENTITY_ONLY' END AS change_type,
  a.r.symbol_id AS old_id, b.r.symbol_id AS new_id FROM a FULL JOIN b ON a.repository_id = b.repository_id AND a.qualified_name = b.qualified_name)
SELECT * FROM c WHERE change_type IS NOT NULL""",
    "reindex_actions": _SYMBOLS
    + """, x AS (SELECT repository_id || '/' || qualified_name AS id, r.body AS t FROM a), y AS (SELECT repository_id || '/' || qualified_name AS id, r.body AS t FROM b)
SELECT y.id AS chunk_id, CASE WHEN x.id IS NOT NULL THEN 'KEEP' WHEN y.t IN (SELECT t FROM x) THEN 'REUSE' ELSE 'EMBED' END AS action FROM y LEFT JOIN x ON x.id = y.id AND x.t = y.t
UNION ALL SELECT x.id, 'REMOVE' FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.id = x.id AND y.t = x.t)""",
    "index_version": _SYMBOLS + "SELECT repository_id, qualified_name, r.symbol_id AS symbol_id, r.place AS place FROM b",
}

_ANSWERS = "WITH " + _ITEMS + """,
an AS (SELECT query_id || ':' || candidate_id AS answer_id, candidate_id AS context_id, symbol_name, coalesce(qualified_name, '') AS code,
  'The ' || symbol_name || ' of ' || coalesce(qualified_name, 'nothing') || ' is shown here' || CASE WHEN rank % 5 = 0 THEN '' WHEN rank % 7 = 0 THEN ' [CTX:none]' ELSE ' [CTX:' || candidate_id || ']' END || '.' AS said
  FROM it WHERE symbol_name IS NOT NULL),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(said), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 3)) AS sw, list_filter(regexp_split_to_array(lower(code), '[^A-Za-z0-9_]+'), lambda x: length(x) >= 3) AS cw FROM an),
v AS (SELECT answer_id, CAST(0 AS INTEGER) AS claim, contains(said, '[CTX:')::BIGINT AS n_citations, contains(said, '[CTX:cand')::BIGINT AS n_valid,
  round(CASE WHEN contains(said, '[CTX:cand') THEN least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN contains(lower(said), lower(symbol_name)) AND symbol_name <> '' THEN 0.4::DOUBLE ELSE 0 END
    + 0.8::DOUBLE * len(list_intersect(sw, cw)) / len(sw)) ELSE 0 END, 6)::DOUBLE AS score FROM w),
s AS (SELECT *, CASE WHEN n_citations = 0 THEN 'UNCITED' WHEN score >= 0.8 THEN 'SUPPORTED' WHEN score >= 0.5 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM v)
"""

_IDS = r"""
WITH q AS (SELECT item_id AS id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS q FROM eval_items),
i AS (SELECT *, list_distinct(regexp_extract_all(q, '\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b', 1)) AS qualified,
  list_filter(list_concat(regexp_extract_all(q, '\b[a-z0-9]+[A-Z][a-zA-Z0-9]*\b'), regexp_extract_all(q, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b'), regexp_extract_all(q, '\b[a-zA-Z0-9]+_[a-zA-Z0-9_]+\b'),
    regexp_extract_all(q, '\b[A-Z]{2,}\b'), regexp_extract_all(q, '\b[A-Z][a-zA-Z0-9]*\b')), lambda x: NOT list_contains([PROSE], lower(x))) AS others FROM q),
k AS (SELECT *, list_distinct(list_concat(qualified, others)) AS ids, lower(q) AS low,
  list_filter(list_transform(string_split(q, ' '), lambda x: lower(regexp_replace(x, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g'))), lambda x: x <> '') AS words FROM i),
m AS (SELECT *, len(ids) AS n_ids, len(list_filter(words, lambda x: list_contains([PROSE], x))) AS n_prose FROM k)
""".replace("PROSE", ", ".join(f"'{w}'" for w in questions.PROSE_WORDS))


def _first(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '(?i){p}') THEN {v}" for v, p in cases) + f" ELSE {other} END"


def _quoted(p: str) -> str:
    return p.replace("'", "''")


_QUESTIONS = (
    _IDS
    + f""", n AS (SELECT *, CASE WHEN q = '' THEN 'UNKNOWN' WHEN regexp_matches(q, '{_quoted(questions.PATH)}') THEN 'PATH_OR_FILE' WHEN len(qualified) > 0 AND n_prose = 0 THEN 'QUALIFIED_IDENTIFIER'
  WHEN {" OR ".join(f"contains(low, '{p}')" for p in questions.RELATION_PHRASES)} THEN 'RELATIONSHIP' WHEN n_prose = 0 AND (n_ids > 0 OR len(words) = 1) THEN 'IDENTIFIER' WHEN n_prose > 0 AND n_ids = 0 THEN 'NATURAL_LANGUAGE'
  WHEN n_ids > 0 THEN 'MIXED' ELSE 'UNKNOWN' END AS kind FROM m),
o AS (SELECT *, {_first([(f"'{p[0]}'", _quoted(p[3])) for p in questions.INTENT_PATTERNS], "CASE WHEN kind IN ('IDENTIFIER', 'QUALIFIED_IDENTIFIER') THEN 'SYMBOL' ELSE 'SEARCH' END")} AS intent,
  {_first([(f"'{p[1]}'", _quoted(p[3])) for p in questions.INTENT_PATTERNS], "'NONE'")} AS relation, kind IN ('IDENTIFIER', 'QUALIFIED_IDENTIFIER') OR (kind = 'MIXED' AND n_ids > 0) AS bare FROM n)
SELECT id AS query_id, kind, intent, relation, CAST(len(list_distinct(list_filter([{", ".join(f"CASE WHEN regexp_matches(q, '(?i){_quoted(p[3])}') THEN '{p[0]}' END" for p in questions.INTENT_PATTERNS)}], lambda x: x IS NOT NULL))) AS INTEGER) AS n_intents,
  {_first([(f"'{p[0]}'", _quoted(p[2])) for p in questions.GRAPH_PATTERNS], "CASE WHEN bare THEN 'IDENTIFIER' END")} AS graph_relation, {_first([(f"'{p[1]}'", _quoted(p[2])) for p in questions.GRAPH_PATTERNS], "CASE WHEN bare THEN 'both' ELSE 'none' END")} AS direction,
  CASE WHEN regexp_matches(low, '{_quoted(questions.FILE_SIGNS)}') THEN 'FILE' WHEN intent = 'ARCHITECTURE' OR regexp_matches(low, 'architecture|system|repository|codebase|overview|project') THEN 'REPOSITORY' WHEN contains(low, 'package') THEN 'PACKAGE'
    WHEN regexp_matches(low, 'module|directory') THEN 'MODULE' WHEN regexp_matches(low, 'class|interface|struct') THEN 'CLASS' WHEN n_ids > 0 THEN 'SYMBOL' ELSE 'UNKNOWN' END AS scope,
  regexp_matches(low, '{_quoted(questions.NEGATIONS)}') AS negated, CAST(n_ids AS INTEGER) AS n_entities FROM o"""
)

SQL |= {
    "grounding_claims": _ANSWERS + "SELECT * FROM s",
    "grounding_summary": _ANSWERS
    + """SELECT answer_id, count(*) AS n_claims, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS partially_supported,
  count(*) FILTER (status = 'UNSUPPORTED') AS unsupported, count(*) FILTER (status = 'UNCITED') AS uncited, sum(n_citations)::BIGINT AS n_citations, sum(n_valid)::BIGINT AS n_valid, round(avg(score), 6) AS mean_score,
  round((count(*) - count(*) FILTER (status = 'UNCITED')) / count(*), 6)::DOUBLE AS citation_coverage, round(count(*) FILTER (status = 'SUPPORTED') / count(*), 6)::DOUBLE AS grounding_coverage,
  CASE WHEN count(*) FILTER (status = 'SUPPORTED') = count(*) THEN 'SUPPORTED' WHEN count(*) FILTER (status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS overall
FROM s GROUP BY 1""",
    "question_identifiers": _IDS + "SELECT id AS query_id, unnest(ids) AS identifier FROM m",
    "question_plans": _QUESTIONS,
    "path_modules": """
WITH p AS (SELECT DISTINCT regexp_replace(replace(trim(path), chr(92), '/'), '^(\\./+)+', '') AS path FROM source_files),
h AS (SELECT path, sha1(unhex('6f1c7a523b0e5d3a9a530d4b1f2c8e77') || path::BLOB) AS h FROM p)
SELECT path, CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.java' THEN 'java' WHEN regexp_matches(lower(path), '\\.(ts|tsx|js|jsx)$') THEN 'typescript' END AS language,
  regexp_replace(replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), '\\.__init__$', '') AS module,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""",
    "changed_files_audit": _CHANGES
    + """, dv AS (SELECT DISTINCT repository_id, snapshot_no, path, change_type FROM c WHERE change_type IS NOT NULL),
lg AS (SELECT DISTINCT lower(trim(repository_id)) AS repository_id, snapshot_no, regexp_replace(replace(trim(path), chr(92), '/'), '^(\\./+)+', '') AS path, upper(trim(change_type)) AS change_type FROM changed_files
  WHERE snapshot_no IS NOT NULL AND nullif(trim(path), '') IS NOT NULL AND change_type IS NOT NULL AND repository_id IS NOT NULL),
bo AS (SELECT coalesce(dv.repository_id, lg.repository_id) AS repository_id, dv.path AS d, lg.path AS l FROM dv FULL JOIN lg ON dv.repository_id = lg.repository_id AND dv.snapshot_no = lg.snapshot_no AND dv.path = lg.path AND dv.change_type = lg.change_type)
SELECT repository_id, count(d) AS n_derived, count(l) AS n_logged, count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) AS n_agreed,
  round(CASE WHEN count(l) > 0 THEN count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) / count(l) ELSE 0 END, 6)::DOUBLE AS precision,
  round(CASE WHEN count(d) > 0 THEN count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) / count(d) ELSE 0 END, 6)::DOUBLE AS recall FROM bo GROUP BY 1""",
    "chunk_entities": _FILES
    + """, n0 AS (SELECT lower(trim(entity_id)) AS node_id, min({'kind': lower(trim(kind)), 'name': nullif(trim(name), ''), 'qn': nullif(trim(qualified_name), ''), 'file_id': nullif(lower(trim(file_id)), ''), 'repo': nullif(lower(trim(repository_id)), ''),
    'pid': nullif(lower(trim(parent_id)), '')}) AS r, min({'s': start_line, 'e': end_line}) AS sp, bool_or(is_async) AS a FROM ir_entities WHERE nullif(trim(entity_id), '') IS NOT NULL GROUP BY 1),
n AS (SELECT node_id, r.kind AS kind, r.name AS name, r.file_id AS file_id, r.pid AS pid, sp, a FROM n0),
ms AS (SELECT pid AS node_id, count(*) AS nm FROM n WHERE kind = 'method' AND pid IS NOT NULL GROUP BY 1),
up AS (SELECT lower(trim(source_symbol_id)) AS node_id, array_to_string(list_sort(list(DISTINCT trim(target_qualified_name)) FILTER (lower(trim(ref_kind)) = 'extends')), ', ') AS ex,
  array_to_string(list_sort(list(DISTINCT trim(target_qualified_name)) FILTER (lower(trim(ref_kind)) = 'implements')), ', ') AS im
  FROM code_refs WHERE lower(trim(ref_kind)) IN ('extends', 'implements') AND nullif(trim(source_symbol_id), '') IS NOT NULL AND nullif(trim(target_qualified_name), '') IS NOT NULL GROUP BY 1),
b0 AS (SELECT node_id, kind, sp.s AS s, sp.e AS e, coalesce(nm, 0) AS nm, CASE WHEN sp.s >= 1 AND sp.e >= sp.s THEN coalesce(lines[sp.s:sp.e], []) ELSE [] END AS txt,
  CASE WHEN kind IN ('class', 'interface') THEN kind || ' ' || coalesce(name, '') || CASE WHEN ex <> '' THEN ' extends ' || ex ELSE '' END || CASE WHEN im <> '' THEN ' implements ' || im ELSE '' END
    ELSE CASE WHEN a THEN 'async ' ELSE '' END || 'def ' || coalesce(name, '') || '()' END AS signature
  FROM n LEFT JOIN l USING (file_id) LEFT JOIN ms USING (node_id) LEFT JOIN up USING (node_id) WHERE kind IN ('class', 'interface', 'function', 'method')),
b AS (SELECT *, len(txt) > 0 AS has, CASE WHEN len(txt) > 0 THEN txt WHEN kind IN ('class', 'interface') THEN [signature || ' {', '  // Methods: ' || nm, '}'] ELSE [signature, '    ...'] END AS body FROM b0),
c AS (SELECT *, CASE WHEN has AND len(body) > 20 THEN ceil(len(body) / 20.0)::INTEGER ELSE 0 END AS n_sub FROM b),
p AS (SELECT *, unnest(range(0, n_sub + 1))::INTEGER AS sub_index FROM c),
q AS (SELECT *, CASE WHEN sub_index > 0 THEN (sub_index - 1) * 20 ELSE 0 END AS f FROM p),
r AS (SELECT *, CASE WHEN n_sub = 0 THEN len(body) WHEN sub_index = 0 THEN 1 ELSE least(20, len(body) - f) END AS z FROM q)
SELECT node_id AS entity_id, CASE WHEN sub_index > 0 THEN 'sub_chunk' ELSE kind END AS chunk_type, sub_index, n_sub, CAST(s + f AS INTEGER) AS start_line, CAST(CASE WHEN has THEN s + f + z - 1 ELSE e END AS INTEGER) AS end_line, signature,
  md5(array_to_string(body[f + 1:f + z], chr(10))) AS digest FROM r""",
}
