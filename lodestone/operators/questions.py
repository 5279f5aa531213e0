"""What a search query is about: its kind, intents, graph relation and scope, for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import PROSE_WORDS, identifiers, normalised_query, qualified_names

# Phrases and patterns by which queries are told apart, with their priorities.
RELATION_PHRASES = (
    "who calls", "who called", "calls", "called by", "which classes implement", "which class implements", "implements", "implementing", "which classes depend",
    "depends on", "depending on", "inherits", "overrides", "references", "referenced by",
)
PATH = r"(?i)(?:[A-Za-z0-9_\-.]+[/\\])+[A-Za-z0-9_\-.]+|\b[A-Za-z0-9_\-]+\.(?:java|py|ts|js|json|md|cpp|cs|go|rs|c|h|hpp|kt|swift)\b"
GRAPH_PATTERNS = (
    ("IMPACT", "inbound", r"\b(?:what\s+(?:will|could)?\s*be\s+affected|what\s+is\s+affected\s+by|what\s+could\s+break|impact\s+of|impact\s+radius)\b"),
    ("calls", "inbound", r"\b(?:who\s+calls?|what\s+calls?|called\s+by|callers?\s+of|where\s+is\s+.*?\s+called)\b"),
    ("calls", "outbound", r"\b(?:what\s+does\s+.*?\s+call|callees?\s+of|calls?\s+made\s+by)\b"),
    ("implements", "inbound", r"\b(?:which\s+classes?\s+implement|who\s+implements|what\s+implements|implementations?\s+of|implementing)\b"),
    ("implements", "outbound", r"\b(?:what\s+does\s+.*?\s+implement|interfaces?\s+implemented\s+by)\b"),
    ("extends", "inbound", r"\b(?:what\s+inherits\s+from|which\s+classes?\s+extend|what\s+extends|subclasses?\s+of|derived\s+classes?)\b"),
    ("extends", "outbound", r"\b(?:what\s+does\s+.*?\s+inherit\s+from|what\s+does\s+.*?\s+extend|superclass\s+of|base\s+class\s+of)\b"),
    ("DEPENDENT", "inbound", r"\b(?:who\s+depends\s+on|what\s+depends\s+on|which\s+code\s+depends\s+on|dependents?\s+of|depending\s+on)\b"),
    ("DEPENDENCY", "outbound", r"\b(?:what\s+does\s+.*?\s+depend\s+on|dependencies\s+of)\b"),
    ("imports", "inbound", r"\b(?:which\s+modules?\s+import|who\s+imports|imported\s+by|where\s+is\s+.*?\s+imported)\b"),
    ("imports", "outbound", r"\b(?:what\s+does\s+.*?\s+import|imports\s+of)\b"),
    ("uses", "inbound", r"\b(?:where\s+is\s+.*?\s+used|who\s+uses|used\s+by|references?\s+to|who\s+references?)\b"),
)
INTENT_PATTERNS = (
    ("DEPENDENCY", "CALLERS", 10, r"\b(?:who|where|which\s+(?:function|method|class|service|component|code))\s+(?:calls|is\s+calling|called|invokes|is\s+invoking|invoked)\b|\bcallers\s+of\b|\bcalled\s+by\b|\bwhere\s+is\s+[\w.]+\s+called\b"),
    ("DEPENDENCY", "CALLEES", 10, r"\bwhat\s+(?:(?:functions?|methods?|classes?|code)\s+)?(?:does|do)\s+[\w.]+\s+(?:call|invoke)\b|\bcallees\s+of\b|\bcalls\s+made\s+by\b|\boutbound\s+calls\b"),
    ("DEPENDENCY", "DEPENDENTS", 10, r"\b(?:who|what|which\s+(?:class|classes|module|modules|component|components|service|services|package|packages))\s+(?:depends|depend)\s+on\b|\bdependents\s+of\b|\bdepending\s+on\b|\bwhich\s+components?\s+use\b"),
    ("DEPENDENCY", "DEPENDENCIES", 10, r"\bwhat\s+does\s+[\w.]+\s+depend\s+on\b|\bdependencies\s+of\b|\bwhat\s+are\s+the\s+dependencies\b"),
    ("DEPENDENCY", "IMPLEMENTS", 10, r"\b(?:which|what|who)\s+(?:class|classes|struct|structs)?\s*(?:implement|implements|implementing)\b|\bimplementations\s+of\b|\bwho\s+implements\b"),
    ("DEPENDENCY", "EXTENDS", 10, r"\b(?:which|what|who)\s+(?:class|classes)?\s*(?:extend|extends|inherits?\s+from|subclasses?\s+of)\b|\bsubclasses\s+of\b|\bderived\s+classes\b"),
    ("DEPENDENCY", "IMPORTS", 10, r"\b(?:which|what|who)\s+(?:module|modules|file|files|package|packages)?\s*(?:import|imports|imported\s+by)\b|\bimports\s+of\b|\bwhat\s+does\s+[\w.]+\s+import\b"),
    ("DEPENDENCY", "USES", 10, r"\bwhere\s+is\s+[\w.]+\s+used\b|\bwho\s+uses\b|\bused\s+by\b|\breferences?\s+to\b|\busages?\s+of\b"),
    ("IMPACT", "IMPACT", 9, r"\bwhat\s+(?:would|will|could)\s+(?:break|be\s+affected|happen)\s+if\b|\bwhat\s+is\s+the\s+impact\s+of\b|\bimpact\s+radius\s+of\b|\baffect(?:s|ed|ing)?\s+if\b|\bchange\s+to\s+[\w.]+\s+(?:affects|impacts)\b"),
    ("DEBUGGING", "NONE", 8, r"\bwhy\s+(?:is|does|isn't|cannot|can't|fails?|failing|error)\b|\bdebug\b|\btrace\s+error\b|\bbug\s+in\b|\bexception\b|\bfailing\b"),
    ("ARCHITECTURE", "NONE", 7, r"\b(?:architecture|overall\s+structure|system\s+design|component\s+overview|how\s+are\s+the\s+(?:[\w.]+\s+)?components\s+organized)\b|\bhigh[\s-]level\s+overview\b"),
    ("SYMBOL", "NONE", 6, r"\bwhere\s+is\s+[\w.]+\s+(?:defined|located|implemented)\b|\bfind\s+definition\s+of\b|\bshow\s+definition\b"),
    ("EXPLANATION", "NONE", 5, r"\bhow\s+does\b|\bexplain\s+how\b|\bexplain\b|\bwhat\s+does\s+[\w.]+\s+do\b|\bdescribe\b|\boverview\s+of\b"),
)
NEGATIONS = r"\b(?:not|no|dont|doesnt|never|without|excluding|except)\b|don't"
FILE_SIGNS = r"\.(?:py|java|ts|tsx|js|jsx|go|rs|cs|cpp|c|h|rb|php|json|xml|yaml|yml|md)|[/\\]|file"


def _words(q: Column) -> Column:
    return F.filter(F.transform(F.split(q, " "), lambda w: F.lower(F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))), lambda w: w != "")


def understand(queries: DataFrame) -> DataFrame:
    """(query_id, kind, intent, relation, n_intents, graph_relation, direction, scope, negated, n_entities).

    queries: (query_id, text). The intent is that of the matching pattern with the highest priority, the first in
    the list at equal ones, SYMBOL for a bare identifier, else SEARCH. Null and blank texts are UNKNOWN.
    """
    q = queries.select("query_id", normalised_query("text").alias("q"))
    q = q.select("*", F.lower("q").alias("low"), identifiers("q").alias("ids"), qualified_names("q").alias("qualified"), _words(F.col("q")).alias("words"))
    q = q.withColumn("n_prose", F.size(F.filter("words", lambda w: w.isin(*PROSE_WORDS)))).withColumn("n_ids", F.size("ids"))
    related = F.lit(False)
    for p in RELATION_PHRASES:
        related = related | F.col("low").contains(p)
    prose, ids = F.col("n_prose") > 0, F.col("n_ids") > 0
    kind = (
        F.when(F.col("q") == "", "UNKNOWN").when(F.col("q").rlike(PATH), "PATH_OR_FILE").when((F.size("qualified") > 0) & ~prose, "QUALIFIED_IDENTIFIER").when(related, "RELATIONSHIP")
        .when(~prose & (ids | (F.size("words") == 1)), "IDENTIFIER").when(prose & ~ids, "NATURAL_LANGUAGE").when(ids, "MIXED").otherwise("UNKNOWN")
    )
    hits = [(p, F.col("q").rlike("(?i)" + p[3])) for p in INTENT_PATTERNS]
    intent = relation = None
    for p, hit in hits:  # the list is in order of priority
        intent = F.when(hit, p[0]) if intent is None else intent.when(hit, p[0])
        relation = F.when(hit, p[1]) if relation is None else relation.when(hit, p[1])
    intents = F.array_distinct(F.filter(F.array(*[F.when(hit, F.lit(p[0])) for p, hit in hits]), lambda x: x.isNotNull()))
    graph = direction = None
    for name, way, pattern in GRAPH_PATTERNS:
        hit = F.col("q").rlike("(?i)" + pattern)
        graph = F.when(hit, name) if graph is None else graph.when(hit, name)
        direction = F.when(hit, way) if direction is None else direction.when(hit, way)
    bare = F.col("kind").isin("IDENTIFIER", "QUALIFIED_IDENTIFIER") | ((F.col("kind") == "MIXED") & ids)
    scope = (
        F.when(F.col("low").rlike(FILE_SIGNS), "FILE").when((F.col("intent") == "ARCHITECTURE") | F.col("low").rlike("architecture|system|repository|codebase|overview|project"), "REPOSITORY")
        .when(F.col("low").contains("package"), "PACKAGE").when(F.col("low").rlike("module|directory"), "MODULE").when(F.col("low").rlike("class|interface|struct"), "CLASS").when(ids, "SYMBOL").otherwise("UNKNOWN")
    )
    out = q.withColumn("kind", kind).withColumn("intent", intent.otherwise(F.when(F.col("kind").isin("IDENTIFIER", "QUALIFIED_IDENTIFIER"), "SYMBOL").otherwise("SEARCH")))
    return out.select(
        "query_id", "kind", "intent", relation.otherwise("NONE").alias("relation"), F.size(intents).alias("n_intents"),
        graph.otherwise(F.when(bare, "IDENTIFIER")).alias("graph_relation"), direction.otherwise(F.when(bare, "both").otherwise("none")).alias("direction"),
        scope.alias("scope"), F.col("low").rlike(NEGATIONS).alias("negated"), F.col("n_ids").alias("n_entities"),
    )
