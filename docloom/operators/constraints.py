"""Keys, references and checks as queries for rows that break them.

Each constraint is a DataFrame (table, constraint, key) of violations; none is
raised by itself. ``require`` asks for the first one before a write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import fold
from docloom.operators.hierarchy import build_hierarchy
from docloom.schemas import ENUMS

SAFE_SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
Tables = dict[str, DataFrame]


def _report(rows: DataFrame, table: str, constraint: str, *key: Column) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("NULL")) for k in key])
    return rows.select(F.lit(table).alias("table_name"), F.lit(constraint).alias("constraint_name"), text.alias("violating_key"))


def unique(df: DataFrame, table: str, name: str, *columns: Column, where: Column | None = None) -> DataFrame:
    """One violation for each key that more than one row has; keys with a null are never equal."""
    rows = df if where is None else df.where(where)
    keys = [c.alias(f"k{i}") for i, c in enumerate(columns)]
    keyed = rows.select(*keys).dropna()
    many = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _report(many, table, name, *[F.col(c) for c in keyed.columns])


def check(df: DataFrame, table: str, name: str, condition: Column, key: Column) -> DataFrame:
    """One violation for each row whose condition is false; a null condition holds, as in SQL."""
    return _report(df.where(~condition), table, name, key)


def foreign_key(df: DataFrame, table: str, name: str, column: Column, parent: DataFrame, parent_key: str) -> DataFrame:
    """One violation for each row that refers to no row of the parent; null refers to nothing."""
    rows = df.select(column.alias("__fk")).where("__fk is not null")
    missing = rows.join(parent.select(F.col(parent_key).alias("__pk")), F.col("__fk") == F.col("__pk"), "left_anti")
    return _report(missing.distinct(), table, name, F.col("__fk"))


def enum(df: DataFrame, table: str, column: str, key: Column) -> DataFrame:
    return check(df, table, f"{column}_allowed", F.col(column).isin(*ENUMS[table, column]), key)


def safe_path(path: Column) -> Column:
    """A relative path of a Markdown file that stays in its folder."""
    clean = ~path.contains("\\") & ~path.startswith("/") & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
    return clean & F.rlike(path, F.lit(r"[^/]\.md$"))


def chunk_violations(chunks: DataFrame, content: str = "content", count: str = "character_count", key: str = "id") -> DataFrame:
    """Blank contents and counts that are not the content's length in characters."""
    blank = check(chunks, "chunks", "content_not_blank", F.rlike(F.coalesce(F.col(content), F.lit("")), F.lit(r"(?U)\S")), F.col(key))
    wrong = check(chunks, "chunks", "character_count_is_length", F.col(count) == F.length(content), F.col(key))
    return blank.unionByName(wrong)


def topic_cycles(topics: DataFrame) -> DataFrame:
    """(key, parent_key, name) of topics (qualified_name, parent_qualified_name) on a cycle of parents, names without case.

    A parent with a shorter name than its child's closes no cycle, so links of
    dotted names need one look, and trees are built only where that fails.
    """
    key, parent = fold(F.col("qualified_name")), fold(F.col("parent_qualified_name"))
    links = topics.where(key.isNotNull() & parent.isNotNull()).select(key.alias("key"), parent.alias("parent_key"), F.col("qualified_name").alias("name"))
    if links.where(F.length("parent_key") >= F.length("key")).isEmpty():
        return links.limit(0)
    # Digests of the names, which ``build_hierarchy`` compares as they are.
    digests = [F.sha2(c, 256).alias(c) for c in ("key", "parent_key")]
    numbered = links.select(F.lit(0).alias("g"), F.xxhash64("key").bitwiseAND((1 << 62) - 1).alias("node"), *digests, F.lit(0).alias("v"))
    lost = build_hierarchy(numbered, "g", "node", "key", "parent_key", "v").where("depth = -1").select(F.col("name").alias("on"))
    return links.join(lost, F.sha2("key", 256) == F.col("on"), "left_semi")


def topic_violations(topics: DataFrame, group: str = "catalog_id", key: str = "topic_id") -> DataFrame:
    """What a topic catalog must hold: safe paths and slugs, own names, clean aliases, unique names and
    paths in any case, existing parents, no cycles."""
    t, k = "topics", F.col(key)
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    folded = F.transform(aliases, lambda a: fold(F.trim(a)))
    name, parent, group_ = fold(F.col("qualified_name")), F.nullif(F.trim("parent_qualified_name"), F.lit("")), F.col(group)
    known = topics.select(group_.alias("pg"), name.alias("pn")).distinct()
    orphans = topics.where(parent.isNotNull()).join(known, group_.eqNullSafe(F.col("pg")) & (fold(parent) == F.col("pn")), "left_anti")
    cyclic = build_hierarchy(topics, group, key).where("root_id = -1")
    parts = [
        check(topics, t, "output_path_safe", safe_path(F.col("output_path")), k),
        check(topics, t, "slug_form", F.rlike("slug", F.lit(SAFE_SLUG)), k),
        check(topics, t, "not_own_parent", parent != F.col("qualified_name"), k),
        check(topics, t, "sort_order_not_negative", F.col("sort_order") >= 0, k),
        check(topics, t, "aliases_not_blank", ~F.exists(folded, lambda a: a == ""), k),
        check(topics, t, "aliases_unique", F.size(F.array_distinct(folded)) == F.size(folded), k),
        enum(topics, t, "kind", k),
        enum(topics, t, "status", k),
        unique(topics, t, "qualified_name_unique", group_, name),
        unique(topics, t, "output_path_unique", group_, fold(F.col("output_path"))),
        _report(orphans, t, "parent_exists", k),
        _report(cyclic, t, "parents_acyclic", F.col("node_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    t, topic = "topic_evidence", F.col("topic_id")
    parts = [
        unique(evidence, t, "topic_chunk_unique", topic, F.col("chunk_id")),
        unique(evidence, t, "topic_rank_unique", topic, F.col("rank")),
        enum(evidence, t, "role", topic),
        check(evidence, t, "rank_positive", F.col("rank") >= 1, topic),
        check(evidence, t, "score_in_range", F.col("score").between(-1.0, 1.0), topic),
    ]
    return reduce(DataFrame.unionByName, parts)


def store_violations(tables: Tables, fresh: Tables | None = None) -> DataFrame:
    """All violations of a store (``schemas.TABLES``), catalogs included.

    With ``fresh`` (rows just added, by table, already part of ``tables``) only
    what these rows can break: their own checks and references, and keys that
    one of them has; of the other rows only keys are read, and tables without
    new rows not at all.
    """
    col = F.col

    def concerned(make):
        """The rule, or nothing for a table without new rows."""
        return lambda name, *args, **kwargs: make(name, *args, **kwargs) if fresh is None or name in fresh else None

    def rows(name: str) -> DataFrame:
        return tables[name] if fresh is None else fresh[name]

    @concerned
    def key(name: str, constraint: str, *columns: str, where: str = "true") -> DataFrame:
        def keys(df: DataFrame, side: str) -> DataFrame:
            return df.where(where).select(*[F.expr(c).alias(f"{side}{i}") for i, c in enumerate(columns)])

        own = keys(tables[name], "k")
        if fresh is not None:
            same = [col(f"k{i}") == col(f"f{i}") for i in range(len(columns))]
            own = own.join(keys(rows(name), "f").dropna().distinct(), reduce(Column.__and__, same), "left_semi")
        return unique(own, name, constraint, *[col(c) for c in own.columns])

    @concerned
    def holds(name: str, constraint: str, condition: Column, of: str = "id") -> DataFrame:
        return check(rows(name), name, constraint, condition, col(of))

    @concerned
    def refers(name: str, constraint: str, column: str, parent: str) -> DataFrame:
        return foreign_key(rows(name), name, constraint, col(column), tables[parent], "id")

    @concerned
    def allowed(name: str, column: str, of: str = "id") -> DataFrame:
        return enum(rows(name), name, column, col(of))

    parts = [
        key("packages", "ecosystem_name_unique", "ecosystem", "name"),
        holds("packages", "name_normalized", F.rlike("name", F.lit(r"^[^-_.A-Z]+(-[^-_.A-Z]+)*$"))),
        key("documentation_versions", "package_version_unique", "package_id", "package_version"),
        allowed("documentation_versions", "status"),
        refers("documentation_versions", "package_exists", "package_id", "packages"),
        allowed("pipeline_runs", "status"),
        refers("pipeline_runs", "version_exists", "documentation_version_id", "documentation_versions"),
        key("sources", "version_url_unique", "documentation_version_id", "canonical_url"),
        allowed("sources", "confirmation_status"),
        refers("sources", "version_exists", "documentation_version_id", "documentation_versions"),
        key("source_documents", "one_current", "source_id", "canonical_url", where="is_current"),
        holds("source_documents", "http_status_range", col("http_status").between(100, 599)),
        refers("source_documents", "source_exists", "source_id", "sources"),
        refers("source_documents", "run_exists", "pipeline_run_id", "pipeline_runs"),
        key("chunks", "document_index_unique", "source_document_id", "chunk_index"),
        holds("chunks", "chunk_index_not_negative", col("chunk_index") >= 0),
        holds("chunks", "character_count_positive", col("character_count") > 0),
        refers("chunks", "document_exists", "source_document_id", "source_documents"),
        key("embedding_versions", "identity_unique", "provider", "model_name", "dimension"),
        holds("embedding_versions", "dimension_positive", col("dimension") > 0),
        key("chunk_embeddings", "chunk_version_unique", "chunk_id", "embedding_version_id"),
        refers("chunk_embeddings", "chunk_exists", "chunk_id", "chunks"),
        refers("chunk_embeddings", "version_exists", "embedding_version_id", "embedding_versions"),
    ]
    if "topic_catalogs" in tables:
        approved = col("status") == "approved"
        parts += [
            refers("topic_catalogs", "version_exists", "documentation_version_id", "documentation_versions"),
            key("topic_catalogs", "version_config_unique", "documentation_version_id", "config_hash"),
            allowed("topic_catalogs", "status"),
            holds("topic_catalogs", "approval_is_whole", (approved == col("approved_by").isNotNull()) & (approved == col("approved_at").isNotNull())),
            key("topics", "qualified_name_unique", "catalog_id", "lower(qualified_name)"),
            key("topics", "output_path_unique", "catalog_id", "lower(output_path)"),
            holds("topics", "slug_form", F.rlike("slug", F.lit(SAFE_SLUG))),
            holds("topics", "output_path_safe", safe_path(col("output_path"))),
            refers("topics", "catalog_exists", "catalog_id", "topic_catalogs"),
            refers("topics", "parent_exists", "parent_topic_id", "topics"),
            holds("topics", "not_own_parent", col("parent_topic_id") != col("id")),
            holds("topics", "sort_order_not_negative", col("sort_order") >= 0),
            allowed("topics", "kind"),
            allowed("topics", "status"),
            key("topic_evidence", "topic_chunk_unique", "topic_id", "chunk_id"),
            key("topic_evidence", "topic_rank_unique", "topic_id", "rank"),
            refers("topic_evidence", "topic_exists", "topic_id", "topics"),
            refers("topic_evidence", "chunk_exists", "chunk_id", "chunks"),
            allowed("topic_evidence", "role", "topic_id"),
            holds("topic_evidence", "rank_positive", col("rank") >= 1, "topic_id"),
            holds("topic_evidence", "score_in_range", col("score").between(-1.0, 1.0), "topic_id"),
        ]
    nothing = check(tables["packages"].limit(0), "packages", "none", F.lit(True), col("id"))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None], nothing)


def require(violations: DataFrame) -> None:
    """Raise ValueError with the first violations, if there are any."""
    first = violations.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.table_name}.{r.constraint_name}: {r.violating_key}" for r in first))
