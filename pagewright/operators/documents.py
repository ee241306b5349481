"""Document algebra: additive merge, reference rewriting, integrity, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.grouped import spread

#: Arenas whose items a merge appends; others of a source are dropped unless asked for.
MERGED = ("groups", "texts", "pictures", "tables", "key_value_items", "form_items")
NOT_MERGED = ("field_regions", "field_items")


def renumbered(items: DataFrame, merge_all: bool = False) -> DataFrame:
    """``items`` (doc_id, plan_ord, arena, idx, ref) of all sources with ``new_ref``, counted per arena in plan order."""
    kept = items if merge_all else items.filter(~F.col("arena").isin(*NOT_MERGED))
    n = F.row_number().over(Window.partitionBy("doc_id", "arena").orderBy("plan_ord", "idx")) - 1
    return kept.withColumn("new_idx", n).withColumn("new_ref", F.concat(F.lit("#/"), "arena", F.lit("/"), n.cast("string")))


def rewritten(edges: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` with every reference of ``columns`` that the mapping (doc_id, plan_ord, ref, new_ref) knows replaced; others stay."""
    out = edges
    for c in columns:
        m = mapping.select("doc_id", "plan_ord", F.col("ref").alias("__old"), F.col("new_ref").alias("__new"))
        out = out.join(m, (out["doc_id"] == m["doc_id"]) & (out["plan_ord"] == m["plan_ord"]) & (out[c] == m["__old"]), "left").select(*(out[x] if x != c else F.coalesce("__new", out[c]).alias(c) for x in out.columns))
    return out


def rewrite_nested(df: DataFrame, mapping: Column, names: tuple[str, ...] = ("ref", "self_ref")) -> DataFrame:
    """The same for nested columns: every string field with one of the names, however deep, goes through the map."""

    def walk(value: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType) and name in names:
            return F.coalesce(F.try_element_at(mapping, value), value)
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(walk(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: walk(v, kind.elementType, name))
        return value

    return df.select(*(walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def merge(items: DataFrame, edges: DataFrame, merge_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items and edges of all sources of each document as one document, sources in plan order.

    Nothing of an earlier source changes; the same source twice gives its items
    twice.  Children of a root follow those of the sources before.
    """
    named = renumbered(items, merge_all)
    moved = rewritten(edges, named, ["parent_ref", "child_ref"])
    if not merge_all:
        moved = moved.filter(~F.regexp_extract("child_ref", r"^#/([^/]+)", 1).isin(*NOT_MERGED))
    n = F.row_number().over(Window.partitionBy("doc_id", "parent_ref").orderBy("plan_ord", "ord")) - 1
    out = named.drop("idx", "ref").withColumnsRenamed({"new_idx": "idx", "new_ref": "ref"})
    return out, moved.withColumn("ord", n)


def first_wins(rows: DataFrame, keys: list[str], order: str = "plan_ord") -> DataFrame:
    """For each key the row of the earliest source: fields of a root group, pages by number, the origin."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def merge_documents(sources: dict[str, DataFrame], merge_all: bool = False) -> dict[str, DataFrame]:
    """Whole documents of several sources as one each, sources in plan order.

    ``items`` and ``edges`` as for ``merge``; of ``fields`` (doc_id, plan_ord, key, value), ``pages`` (doc_id, plan_ord,
    page_no, ...) and ``origins`` (doc_id, plan_ord, ...), where given, the earliest source's row of each key, page or document stays.
    """
    items, edges = merge(sources["items"], sources["edges"], merge_all)
    keys = {"fields": ["doc_id", "key"], "pages": ["doc_id", "page_no"], "origins": ["doc_id"]}
    return {"items": items, "edges": edges} | {k: first_wins(sources[k], by) for k, by in keys.items() if k in sources}


def integrity_errors(items: DataFrame, edges: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(doc_id, error, ref): what is wrong with the documents' references.

    ``items``: doc_id, ref, kind (null if unset), parent_ref.  ``edges``: doc_id,
    parent_ref, child_ref.  ``comments``: doc_id, ref of a table, comment_ref.
    The roots ``#/body`` and ``#/furniture`` always resolve.
    """
    roots = F.array(F.lit("#/body"), F.lit("#/furniture"))
    no = F.lit(None).cast("string")

    # every item and edge is read once; a reference, or a pair of parent and child, meets its uses in one aggregate
    item = F.array(
        F.struct(F.when(F.col("ref") != "", F.col("ref")).alias("ref"), no.alias("child"), F.lit("item").alias("use")),
        F.struct(F.when(F.coalesce("ref", F.lit("")) == "", "").alias("ref"), no.alias("child"), F.lit("empty").alias("use")),
        F.struct(F.when(F.col("kind").isNull(), F.coalesce("ref", F.lit(""))).alias("ref"), no.alias("child"), F.lit("unset").alias("use")),
        F.struct(F.when(~F.array_contains(roots, F.col("parent_ref")), F.col("parent_ref")).alias("ref"), no.alias("child"), F.lit("parent").alias("use")),
        F.struct(F.when(F.col("ref") != "", F.col("parent_ref")).alias("ref"), F.col("ref").alias("child"), F.lit("has").alias("use")),
    )
    edge = F.array(
        F.struct(F.when(~F.array_contains(roots, F.col("child_ref")), F.col("child_ref")).alias("ref"), no.alias("child"), F.lit("child").alias("use")),
        F.struct(F.col("parent_ref").alias("ref"), F.col("child_ref").alias("child"), F.lit("lists").alias("use")),
    )
    rows = items.select("doc_id", F.inline(item)).unionByName(edges.select("doc_id", F.inline(edge)))
    if comments is not None:
        known = comments.filter(~F.array_contains(roots, F.col("comment_ref")))
        rows = rows.unionByName(known.select("doc_id", F.col("comment_ref").alias("ref"), no.alias("child"), F.lit("comment").alias("use")))
    kinds = ("item", "empty", "unset", "parent", "child", "comment", "has", "lists")
    # what came before is small and merged into few parts: the uses are dealt out first, or one task counts millions of references
    counts = spread(rows.filter("ref is not null"), "doc_id", "ref", "child").groupBy("doc_id", "ref", "child").agg(*(F.count_if(F.col("use") == k).alias(f"n_{k}") for k in kinds))
    unknown = F.col("n_item") == 0
    wrong = (
        ("empty self_ref", F.lit(True), "n_empty"),
        ("unset item", F.lit(True), "n_unset"),
        ("unresolved child", unknown, "n_child"),
        ("unresolved parent", unknown, "n_parent"),
        ("unresolved table comment", unknown, "n_comment"),
        ("parent does not list child", F.col("n_lists") == 0, "n_has"),
    )
    found = [F.array_repeat(F.lit(error), F.when(cond, F.col(count)).otherwise(F.lit(0)).cast("int")) for error, cond, count in wrong]
    found.append(F.array_repeat(F.lit("duplicate self_ref"), (F.col("n_item") > 1).cast("int")))
    return counts.select("doc_id", F.explode(F.concat(*found)).alias("error"), F.coalesce("child", "ref").alias("ref"))


def planned_collectors(wanted: Column, office: Column) -> Column:
    """Collectors to run: those wanted without repeats or unset ones, in first-seen order; none wanted, by format."""
    some = F.array_distinct(F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda c: c != "UNSPECIFIED"))
    return F.when(F.size(some) > 0, some).when(office, F.array(F.lit("LIBREOFFICE"))).otherwise(F.array(F.lit("CV")))


def status_rollup(outcomes: DataFrame) -> DataFrame:
    """(doc_id, status, code, message): the conversion status of each document from its collectors' outcomes."""
    ordered = F.array_sort(F.collect_list(F.struct("plan_ord", "success", "error", "code")))
    g = outcomes.groupBy("doc_id").agg(ordered.alias("o"))
    failed = F.filter("o", lambda x: ~x["success"])
    good = F.size("o") - F.size(failed)
    messages = F.array_join(F.transform(failed, lambda x: F.coalesce(x["error"], F.lit(""))), "; ")
    return g.select(
        "doc_id",
        F.when(good == 0, "FAILURE").when(F.size(failed) > 0, "PARTIAL_SUCCESS").otherwise("SUCCESS").alias("status"),
        F.when(good == 0, F.try_element_at(failed, F.lit(1))["code"]).otherwise("OK").alias("code"),
        messages.alias("message"),
    )


def warnings_by_collector(outcomes: DataFrame) -> DataFrame:
    """(doc_id, key, warnings): the warnings of each collector under ``collector_warnings:<name>``, in plan order."""
    some = outcomes.filter(F.size("warnings") > 0)
    rows = some.groupBy("doc_id", "collector").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("plan_ord", "warnings"))), lambda x: x["warnings"])).alias("warnings"))
    return rows.select("doc_id", F.concat(F.lit("collector_warnings:"), F.lower("collector")).alias("key"), "warnings")


def unset_option_errors(options: Column, allowed: tuple[str, ...] = ("to_formats", "collectors")) -> Column:
    """Names of populated options beyond the two that are honoured."""
    return F.filter(F.map_keys(options), lambda k: ~k.isin(*allowed))


# Status codes that a collector's failure keeps; any other is UNAVAILABLE.
KEPT_CODES = ("INVALID_ARGUMENT", "RESOURCE_EXHAUSTED", "DEADLINE_EXCEEDED")


def collector_code(code: Column) -> Column:
    return F.when(code.isin(*KEPT_CODES), code).otherwise("UNAVAILABLE")


def gather(docs: DataFrame, plan: list[tuple[str, object]], merge_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, edges, outcomes) of all collectors over ``docs``, merged in plan order.

    A collector is a name and a function from the documents to (items, edges,
    errors): items (doc_id, arena, idx, ref, text), edges (doc_id, parent_ref,
    child_ref, ord), errors (doc_id, code, error).  One that fails while it is
    planned fails for every document and leaves the others alone; one that fails
    while it runs fails the job, so it has to give what it cannot read as errors.
    """
    items: list[DataFrame] = []
    edges: list[DataFrame] = []
    outcomes: list[DataFrame] = []
    no_warnings = F.array().cast("array<string>").alias("warnings")
    for n, (name, run) in enumerate(plan):
        head = [F.lit(n).alias("plan_ord"), F.lit(name).alias("collector")]
        try:
            i, e, errors = run(docs)
        except Exception as failure:  # isolated: the plan goes on
            text = str(failure)
            outcomes.append(docs.select("doc_id", *head, F.lit(False).alias("success"), F.lit(text).alias("error"), F.lit("INTERNAL").alias("code"), no_warnings))
            continue
        items.append(i.select("doc_id", F.lit(n).alias("plan_ord"), "arena", "idx", "ref", "text"))
        edges.append(e.select("doc_id", F.lit(n).alias("plan_ord"), "parent_ref", "child_ref", "ord"))
        first = errors.groupBy("doc_id").agg(F.min(F.struct("code", "error")).alias("x"))
        outcomes.append(docs.select("doc_id").join(first, "doc_id", "left").select("doc_id", *head, F.col("x").isNull().alias("success"), F.col("x.error").alias("error"), F.col("x.code").alias("code"), no_warnings))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    if not items:
        raise ValueError("every collector failed")
    merged = merge(union(items), union(edges), merge_all)
    return *merged, union(outcomes)
