"""What a search string asks for: route, intent, terms, expansion and keyword plan, for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, sorted_distinct, strings

# Words that tell an intent, in the order they are tried.
HISTORICAL_CUES = ["什么时候", "哪天", "何时", "开始", "关停", "启用", "停用", "暂停", "删除", "创建", "发生", "当时", "原话", "对话", "时间线", "历史", "timeline", "when", "history", "transcript", "started", "stopped", "disabled", "enabled", "shutdown"]
CONFIG_CUES = ["配置", "cron", "env", "端口", "service", "systemd", "日志", "报错", "失败", "error", "config", "port"]
CONCEPT_CUES = ["是什么", "什么是", "定义", "原则", "方式", "怎么理解", "概念", "concept", "definition", "principle"]
# Expansions of terms.
EXPANSIONS = {
    "rag": ["retrieval", "augmented", "generation"], "llm": ["large", "language", "model"], "mcp": ["model", "context", "protocol"], "bm25": ["keyword", "fts", "fts5"],
    "fts": ["keyword", "bm25"], "fts5": ["keyword", "bm25"], "embedding": ["vector", "semantic"], "embeddings": ["vector", "semantic"], "vector": ["embedding", "semantic"],
    "eval": ["evaluation", "benchmark", "quality"], "评测": ["eval", "evaluation", "benchmark"], "向量": ["vector", "embedding"], "检索": ["search", "retrieval"], "记忆": ["memory", "recall"],
}
# Terms that name no place, and the length of a short query.
ROUTE_STOP_TERMS = ["什么", "怎么", "如何", "是否", "一个", "这个", "那个", "还有", "不是", "里面", "the", "and", "for", "with", "from"]
SHORT_CHARS = 12


def normalized_query(raw: Column) -> Column:
    """Other characters than letters, digits and white space to spaces, squeezed; the case stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def route(raw: Column, folded: Column, terms: Column) -> Column:
    return (
        F.when(folded.contains("/") | folded.contains(".md") | folded.startswith("path:"), "path").when(folded.contains("#") | folded.startswith("tag:"), "tag")
        .when((F.size(terms) <= 1) | (F.length(raw) <= SHORT_CHARS), "short").otherwise("semantic")
    )


def intent(folded: Column, normalized: Column, terms: Column) -> Column:
    hay = F.concat_ws(" ", folded, normalized)
    brief = (F.size(terms) <= 2) & (F.length(folded) <= 16)
    return F.when(contains_any(hay, HISTORICAL_CUES), "historical").when(contains_any(hay, CONFIG_CUES), "config").when(contains_any(hay, CONCEPT_CUES) | brief, "concept").otherwise("general")


def expansions(terms: Column) -> Column:
    """Further terms, each once, in the order of what they come from."""
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), strings(*v))])
    found = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), strings())))
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(terms, t)))


def without_stopwords(terms: Column, stopwords: list[str]) -> Column:
    """Terms less learned stop-words; all of them if none would be left."""
    left = F.filter(terms, lambda t: ~F.lower(t).isin([s.lower() for s in stopwords])) if stopwords else terms
    return F.when(F.size(left) == 0, terms).otherwise(left)


def clean_route_term(term: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(term), "^(path:)+", ""), "^(tag:)+", ""), "^#+", "")
    return F.lower(F.btrim(bare, F.lit("\"'()")))


def analyze(queries: DataFrame, expand: bool = False, stopwords: list[str] | None = None) -> DataFrame:
    """queries: query_id, raw. Adds folded, normalized, terms, route, intent, expanded, all_terms, patterns, route_terms,
    scoring_text, keyword_mode (and, or, none), keyword_terms (array of term and prefix) and routes_attempted."""
    stop = stopwords or []
    q = queries.withColumns({"folded": F.lower(F.trim("raw")), "normalized": normalized_query(F.col("raw"))})
    q = q.withColumn("terms", F.filter(F.split("normalized", " "), lambda t: t != ""))
    q = q.withColumns({"route": route(F.col("raw"), F.col("folded"), F.col("terms")), "intent": intent(F.col("folded"), F.col("normalized"), F.col("terms"))})
    expanded = F.when(F.col("route").isin("path", "tag"), strings()).otherwise(expansions(F.col("terms"))) if expand else strings()
    q = q.withColumn("expanded", expanded)
    patterns = sorted_distinct(F.concat(F.filter(F.array("folded", "normalized"), lambda p: F.trim(p) != ""), F.col("expanded")))
    q = q.withColumn("patterns", without_stopwords(patterns, stop)).withColumns({"terms": without_stopwords(F.col("terms"), stop), "expanded": without_stopwords(F.col("expanded"), stop)})
    q = q.withColumn("all_terms", sorted_distinct(F.concat("terms", "expanded")))
    cleaned = F.transform(F.concat("patterns", "all_terms"), clean_route_term)
    usable = F.filter(cleaned, lambda t: (F.length(t) >= 2) & ~F.trim(t).rlike(r"\s") & ~t.isin(ROUTE_STOP_TERMS))
    short, plain = F.col("route") == "short", F.size("expanded") == 0
    one = short & plain & (F.size("all_terms") == 1)
    prefix = lambda t: F.when(plain, one).otherwise(short & (F.length(t) <= SHORT_CHARS))
    tried = F.array_compact(F.array(F.lit("keyword"), F.lit("vector"), F.when(F.col("route").isin("path", "short"), "path"), F.when(F.col("route") == "tag", "tag")))
    return q.withColumns({
        "route_terms": sorted_distinct(usable),
        "scoring_text": F.when(F.size("all_terms") == 0, F.col("normalized")).otherwise(F.array_join("all_terms", " ")),
        "keyword_mode": F.when(F.size("all_terms") == 0, "none").when(plain, "and").otherwise("or"),
        "keyword_terms": F.transform("all_terms", lambda t: F.struct(F.lower(t).alias("term"), prefix(t).alias("prefix"))),
        "routes_attempted": sorted_distinct(tried),
    })
