"""JSON Schema documents as tables, and what changes between two versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from termsheet.functions.text import camel_label, let
from termsheet.session import reliable_checkpoint

_DESCRIPTOR_LEVELS = 6          # properties of nested objects are followed this deep
_LEVELS_AT_ONCE = 4             # the diff looks this many levels further before it asks whether any are left
_POINTER = r'"\$ref"\s*:\s*"(#/[^"]*)"'

# What a schema node says about itself.
_PARTS = {
    "type": ("$.type", "string"), "description": ("$.description", "string"),
    "enum": ("$.enum", "array<variant>"), "const": ("$.const", "variant"),
    "one_of": ("$.oneOf", "array<variant>"), "properties": ("$.properties", "map<string,variant>"),
    "required": ("$.required", "array<string>"), "pattern": ("$.patternProperties", "variant"),
    "items": ("$.items", "variant"),
}


def _ref(v: Column) -> Column:
    """The pointer that a node refers to."""
    return let(F.try_variant_get(v, '$["$ref"]', "string"), lambda r: F.when(r.startswith("#/"), r))


def _node(v: Column) -> Column:
    """Struct of a node's own parts and the pointer it refers to."""
    return F.struct(_ref(v).alias("ref"),
                    *[F.try_variant_get(v, path, kind).alias(name) for name, (path, kind) in _PARTS.items()])


def _merged(node: Column, target: Column) -> Column:
    """A node with a reference takes the target's parts; its own fill what the target leaves open."""
    return F.struct(target["ref"].alias("ref"), *[F.coalesce(target[n], node[n]).alias(n) for n in _PARTS])


def _follow(v: Column, defs: Column) -> Column:
    """A node with the definition it refers to put in."""
    return let(_node(v), lambda n: _resolved(n, defs))


def _resolved(node: Column, defs: Column) -> Column:
    return let(F.try_element_at(defs, node["ref"]),
               lambda t: F.when(t.isNull(), node).otherwise(_merged(node, t)))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(
        F.try_variant_get(v, "$", "string"))


def _at_pointer(doc: Column, pointer: Column) -> Column:
    """The node at a ``#/a/b`` pointer; null if there is none."""
    return F.aggregate(F.split(F.substring(pointer, F.lit(3), F.length(pointer)), "/"), doc,
                       lambda v, name: F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), name))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, json text) to (doc_id, doc VARIANT, defs) with references resolved.

    ``defs`` holds the node of every pointer that the document refers to.  Chains of references are
    shortened by following every node's reference at once, as often as it takes for the longest chain
    that as many pointers can form; references in a circle stay unresolved.
    """
    out = docs.withColumn("doc", F.try_parse_json("json"))
    pointers = F.array_distinct(F.regexp_extract_all("json", F.lit(_POINTER), F.lit(1)))
    found = F.filter(F.transform(pointers, lambda p: F.struct(p.alias("p"), _at_pointer(F.col("doc"), p).alias("v"))), lambda e: e["v"].isNotNull())
    out = out.withColumn("defs", F.coalesce(F.map_from_entries(F.transform(found, lambda e: F.struct(e["p"], _node(e["v"])))),
                                            F.map_from_arrays(F.array().cast("array<string>"), F.transform(F.array().cast("array<string>"), lambda _: _node(F.col("doc"))))))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("defs") + 1)).cast("int"))
    shorter = lambda defs, _: F.transform_values(defs, lambda _, n: _resolved(n, defs))
    return out.withColumn("defs", F.aggregate(rounds, F.col("defs"), shorter)).drop("json")


def model_entries(docs: DataFrame) -> DataFrame:
    """One row per model of a schema document: name, position and its ``oneOf`` entry."""
    listed = docs.select("*", F.posexplode(F.try_variant_get("doc", "$.oneOf", "array<variant>")).alias("ord", "entry"))
    name = F.try_variant_get("entry", "$.properties.model.const", "string")
    return listed.withColumn("model", name).filter("model IS NOT NULL")


def schema_versions(docs: DataFrame) -> DataFrame:
    """Version tag in the schema id, ``unknown`` without one."""
    sid = F.coalesce(F.try_variant_get("doc", '$["$id"]', "string"), F.lit("unknown"))
    found = F.regexp_extract(sid, r"\.(v\d+)\.", 1)
    return docs.select("doc_id", sid.alias("schema_id"),
                       F.when(found != "", found).otherwise(F.lit("unknown")).alias("schema_version"))


_NO_TEXT = "array<string>"


def _allowed(node: Column, options: Column) -> Column:
    """Allowed values: the enumeration, else the constant; then the constants of alternatives."""
    listed = F.coalesce(F.transform(node["enum"], _text),
                        F.when(node["const"].isNotNull(), F.array(_text(node["const"]))))
    chosen = F.transform(F.filter(options, lambda o: o.isNotNull()), _text)
    empty = F.array().cast(_NO_TEXT)
    return F.concat(F.coalesce(listed, empty), F.coalesce(chosen, empty))


def _describe(node: Column, defs: Column) -> Column:
    """S13 view of a property: objects with properties are entered, all else is a leaf."""
    kind = F.coalesce(node["type"], F.lit("string"))
    # Alternatives are looked up too, so a referenced constant counts.
    options = F.transform(node["one_of"], lambda o: _follow(o, defs)["const"])
    return F.struct(
        kind.alias("data_type"), F.lit(False).alias("is_dynamic"), _allowed(node, options).alias("enum_values"),
        F.lit("").alias("suffix"), F.when(kind == "object", node["properties"]).alias("inner"),
        node["required"].alias("inner_required"))


def _describe_for_diff(node: Column, defs: Column) -> Column:
    """D1 view: lists of objects are entered as ``path[*]``; pattern objects are dynamic leaves."""
    def option(o: Column) -> Column:
        return F.coalesce(F.try_variant_get(o, "$.const", "variant"),
                          F.try_variant_get(o, '$.properties["$type"].const', "variant"))

    def view(item: Column) -> Column:
        is_list = F.coalesce(node["type"] == "array", F.lit(False))
        dynamic = node["pattern"].isNotNull() & (F.coalesce(F.size(node["properties"]), F.lit(0)) <= 0)
        nested = F.coalesce(node["type"] == "object", F.lit(False)) | node["properties"].isNotNull()
        holder = F.when(is_list & ~nested, item).otherwise(node)
        inner = F.when(dynamic, F.lit(None)).when(nested, F.coalesce(
            node["properties"], F.create_map().cast("map<string,variant>"))).when(is_list, item["properties"])
        return F.struct(
            F.when(dynamic, F.lit("object(dynamic)")).otherwise(F.coalesce(node["type"], F.lit("any"))).alias("data_type"),
            dynamic.alias("is_dynamic"),
            F.when(dynamic, F.array().cast(_NO_TEXT)).otherwise(
                _allowed(holder, F.transform(holder["one_of"], option))).alias("enum_values"),
            F.when(is_list & ~nested, F.lit("[*]")).otherwise(F.lit("")).alias("suffix"),
            inner.alias("inner"), holder["required"].alias("inner_required"))
    return let(_follow(node["items"], defs), view)


def _properties(properties: Column, required: Column, prefix: Column | None, defs: Column, describe, seen: Column) -> Column:
    """array of property views, references followed; the model discriminator is left out.

    ``seen`` are the pointers on the way here: a node that refers back to one of them is a leaf.
    """
    kept = F.filter(F.map_entries(properties), lambda e: e["key"] != "model")

    def one(e: Column, node: Column) -> Column:
        used = F.coalesce(_ref(e["value"]), _ref(node["items"]))
        circle = F.coalesce(F.array_contains(seen, used), F.lit(False))
        path = F.concat(prefix, F.lit("."), e["key"]) if prefix is not None else e["key"]
        return let(describe(node, defs), lambda v: F.struct(
            path.alias("path"), e["key"].alias("key"), F.coalesce(node["description"], F.lit("")).alias("description"),
            F.coalesce(F.array_contains(required, e["key"]), F.lit(False)).alias("required"),
            *[v[n].alias(n) for n in ("data_type", "is_dynamic", "enum_values", "suffix", "inner_required")],
            F.when(~circle, v["inner"]).alias("inner"), F.when(used.isNull(), seen).otherwise(F.array_append(seen, used)).alias("seen")))
    return F.transform(kept, lambda e: let(_follow(e["value"], defs), lambda node: one(e, node)))


def _walk(docs: DataFrame, describe, levels: int | None = None) -> DataFrame:
    """Leaf properties of every model, followed level by level.

    Each level is a projection over the rows before it: nodes with properties are replaced by
    them, leaves stay.  With ``levels``, nodes still open after them are left out; without, the
    walk goes on until none is open.
    """
    entries = model_entries(docs).select("doc_id", "model", "defs", _follow(F.col("entry"), F.col("defs")).alias("root"))
    none_seen = F.array().cast("array<string>")
    rows = entries.select("doc_id", "model", "defs", F.explode(_properties(
        F.col("root.properties"), F.col("root.required"), None, F.col("defs"), describe, none_seen)).alias("leaf"))

    deeper = _properties(F.col("leaf.inner"), F.col("leaf.inner_required"),
                         F.concat("leaf.path", "leaf.suffix"), F.col("defs"), describe, F.col("leaf.seen"))
    opened = F.explode(F.when(F.col("leaf.inner").isNotNull(), deeper).otherwise(F.array("leaf"))).alias("leaf")

    def further(rows: DataFrame, n: int) -> DataFrame:
        for _ in range(n):
            rows = rows.select("doc_id", "model", "defs", opened)
        return rows

    if levels is not None:
        return further(rows, levels - 1).filter("leaf.inner IS NULL")
    done = None
    while True:                                                   # schema documents are few and small
        rows = reliable_checkpoint(further(rows, _LEVELS_AT_ONCE))
        closed = rows.filter("leaf.inner IS NULL")
        done = closed if done is None else done.unionByName(closed)
        rows = rows.filter("leaf.inner IS NOT NULL")
        if rows.isEmpty():
            return done


def descriptors(docs: DataFrame) -> DataFrame:
    """Field descriptors of every model of resolved schema documents."""
    return _walk(docs, _describe, _DESCRIPTOR_LEVELS).select(
        "doc_id", "model", F.col("leaf.path").alias("field_path"), camel_label(F.col("leaf.key")).alias("label"),
        "leaf.data_type", "leaf.description", "leaf.required", "leaf.enum_values")


def diff_fields(docs: DataFrame) -> DataFrame:
    """Fields as the diff sees them: list members as ``path[*].x``, dynamic objects flagged."""
    return _walk(docs, _describe_for_diff).select(
        "doc_id", "model", F.col("leaf.path").alias("field_path"), "leaf.data_type", "leaf.description",
        "leaf.required", "leaf.enum_values", "leaf.is_dynamic")


# ---- differences -------------------------------------------------------------------------

def content_hash(v: Column) -> Column:
    """First 16 hex digits of the SHA-256 of canonical JSON (keys sorted at every level)."""
    return F.substring(F.sha2(F.to_json(v), 256), 1, 16)


def definition_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions (name, definition VARIANT) removed, added or changed."""
    a = old.select("name", content_hash(F.col("definition")).alias("old_hash"))
    b = new.select("name", content_hash(F.col("definition")).alias("new_hash"))
    status = (F.when(F.col("new_hash").isNull(), F.lit("removed")).when(F.col("old_hash").isNull(), F.lit("added"))
              .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed")))
    return (a.join(b, "name", "full_outer").withColumn("status", status).filter("status IS NOT NULL")
            .select("name", "status", F.when(F.col("status") == "added", F.lit("safe"))
                    .otherwise(F.lit("caution")).alias("severity")))


def same_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content hashes of two versions of each document and whether they agree."""
    a = old.select("doc_id", content_hash(F.col("doc")).alias("active_hash"))
    b = new.select("doc_id", content_hash(F.col("doc")).alias("new_hash"))
    return a.join(b, "doc_id").withColumn("same_content", F.col("active_hash") == F.col("new_hash"))


def model_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """D3: models of two descriptor tables: new, removed or common."""
    a = old.select("model").distinct().withColumn("was", F.lit(True))
    b = new.select("model").distinct().withColumn("now", F.lit(True))
    return a.join(b, "model", "full_outer").select("model", F.when(F.col("was").isNull(), F.lit("new")).when(
        F.col("now").isNull(), F.lit("removed")).otherwise(F.lit("common")).alias("status"))


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per field change with its severity.

    A new model's fields are added and safe; a removed model lists no fields; in common models
    fields may be added, removed, or change type, allowed values, required flag or description.
    """
    names = ["data_type", "description", "required", "enum_values"]
    a = old.select("model", "field_path", F.struct(*names).alias("o"))
    b = new.select("model", "field_path", F.struct(*names).alias("n"))
    rows = a.join(b, ["model", "field_path"], "full_outer").join(model_status(old, new), "model")
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    gone, come = F.array_except("o.enum_values", "n.enum_values"), F.array_except("n.enum_values", "o.enum_values")

    def change(when: Column, kind: Column | str, severity: Column | str, detail: Column | None = None) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x                      # noqa: E731
        return F.when(when, F.struct(lit(kind).alias("change"), lit(severity).alias("severity"),
                                     (detail if detail is not None else F.lit(None).cast("string")).alias("detail")))

    added = F.when((F.col("status") == "common") & n["required"], F.lit("breaking")).otherwise(F.lit("safe"))
    flag = F.when(n["required"], F.lit("required_added")).otherwise(F.lit("required_removed"))
    changes = F.array(
        change(o.isNull(), "added", added, n["data_type"]),
        change(n.isNull() & (F.col("status") == "common"), "removed", "breaking", o["data_type"]),
        change(both & (o["data_type"] != n["data_type"]), "type_changed", "breaking",
               F.concat(o["data_type"], F.lit(" -> "), n["data_type"])),
        change(both & (F.size(gone) > 0), "enum_removed", "breaking", F.array_join(F.array_sort(gone), ",")),
        change(both & (F.size(come) > 0), "enum_added", "safe", F.array_join(F.array_sort(come), ",")),
        change(both & (o["required"] != n["required"]), flag,
               F.when(n["required"], F.lit("breaking")).otherwise(F.lit("caution"))),
        change(both & (o["description"] != n["description"]), "desc_changed",
               F.when(n["required"], F.lit("caution")).otherwise(F.lit("safe")), F.substring(n["description"], 1, 120)))
    return rows.select("model", "field_path", F.inline(F.array_compact(changes)))


def severity_rank(c: Column) -> Column:
    return F.when(c == "breaking", 2).when(c == "caution", 1).otherwise(0)


def model_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed, new and removed models with the worst severity of their changes."""
    worst = field_changes(old, new).groupBy("model").agg(
        F.max(severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n"))
    rows = model_status(old, new).join(worst, "model", "left")
    status = F.when(F.col("status") == "common", F.when(F.col("n") > 0, F.lit("changed"))).otherwise(F.col("status"))
    severity = (F.when(F.col("status") == "removed", F.lit("breaking")).when(F.col("status") == "new", F.lit("safe"))
                .otherwise(F.element_at(F.array(*map(F.lit, ("safe", "caution", "breaking"))), F.coalesce("rank", F.lit(0)) + 1)))
    return rows.select("model", status.alias("status"), severity.alias("severity")).filter("status IS NOT NULL")


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger word set; two empty texts agree fully."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def rename_candidates(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Removed and added fields of one model and type that look alike.

    A pair scores half the word overlap of descriptions and half that of last path segments, so one of the
    two overlaps must reach ``threshold``.  Sets that overlap that much share one of their rarest words: of
    n words all but the n * threshold most frequent.  Only those are joined on, so words that nearly all
    fields have bring no pairs together.  Two empty texts overlap wholly.
    """
    a = old.join(new.select("model", "field_path"), ["model", "field_path"], "left_anti")
    b = new.join(old.select("model", "field_path"), ["model", "field_path"], "left_anti")

    def marked(df: DataFrame, side: str) -> DataFrame:
        segment = F.substring_index("field_path", ".", -1)
        words = df.select("model", "data_type", F.col("field_path").alias(f"{side}_path"), F.col("description").alias(f"{side}_description"),
                          _words(F.col("description")).alias(f"{side}_words"), _words(segment).alias(f"{side}_segment"))
        kinds = F.array(F.struct(F.lit("d:").alias("kind"), F.col(f"{side}_words").alias("w")), F.struct(F.lit("s:").alias("kind"), F.col(f"{side}_segment").alias("w")))
        return words.withColumn("k", F.explode(kinds)).withColumn("word", F.explode(
            F.when(F.size("k.w") > 0, F.col("k.w")).otherwise(F.array(F.lit("")))))

    sides = marked(a, "old"), marked(b, "new")
    seen = sides[0].select("k.kind", "word").unionByName(sides[1].select("k.kind", "word")).groupBy("kind", "word").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, side: str) -> DataFrame:
        size = F.greatest(F.size("k.w"), F.lit(1))
        kept = size - F.ceil(size * (threshold - 0.005)) + 1      # scores are rounded to two digits
        order = Window.partitionBy("model", "data_type", f"{side}_path", "kind").orderBy("n", "word")
        rows = df.withColumn("kind", F.col("k.kind")).join(seen, ["kind", "word"]).withColumn("place", F.row_number().over(order))
        return rows.filter(F.col("place") <= kept).drop("k", "n", "place")

    met = (rarest(sides[0], "old").join(rarest(sides[1], "new"), ["model", "data_type", "kind", "word"]).drop("kind", "word")
           .dropDuplicates(["model", "data_type", "old_path", "new_path"]))
    score = F.round(0.5 * word_overlap(F.col("old_words"), F.col("new_words"))
                    + 0.5 * word_overlap(F.col("old_segment"), F.col("new_segment")), 2)
    return (met.withColumn("confidence", score).filter(F.col("confidence") >= threshold)
            .select("model", "data_type", "old_path", "new_path", "confidence", "old_description", "new_description"))


def rename_suggestions(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one renames, each removed field in path order taking the best field still free.

    Only the candidate edges of one model reach the greedy step, and a model is one schema's
    field list.
    """
    schema = "model string, old_path string, new_path string, confidence double"

    def greedy(edges: pd.DataFrame) -> pd.DataFrame:
        ordered = edges.sort_values(["old_path", "confidence", "new_path"], ascending=[True, False, True])
        served, taken, rows = set(), set(), []
        for edge in ordered.itertuples():
            if edge.old_path not in served and edge.new_path not in taken:
                served.add(edge.old_path)
                taken.add(edge.new_path)
                rows.append((edge.model, edge.old_path, edge.new_path, edge.confidence))
        return pd.DataFrame(rows, columns=["model", "old_path", "new_path", "confidence"])

    edges = rename_candidates(old, new, threshold).select("model", "old_path", "new_path", "confidence")
    return edges.groupBy("model").applyInPandas(greedy, schema)


def cross_reference(changes: DataFrame, registry: DataFrame, labels: DataFrame, issuer_labels: DataFrame,
                    counts: DataFrame) -> DataFrame:
    """Whether each changed path has a parser, which labels and issuers use it, stored rows."""
    def listed(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.groupBy("field_path").agg(F.array_sort(F.collect_set(value)).alias(name))
    empty = F.array().cast("array<string>")
    return (changes.join(registry.select("field_path").distinct().withColumn("p", F.lit(True)), "field_path", "left")
            .join(listed(labels, "label_raw", "labels"), "field_path", "left")
            .join(listed(issuer_labels, "issuer_key", "issuers"), "field_path", "left")
            .join(counts.select("field_path", F.col("rows_found").alias("stored_rows")), "field_path", "left")
            .withColumns({"has_parser": F.coalesce("p", F.lit(False)), "labels": F.coalesce("labels", empty),
                          "issuers": F.coalesce("issuers", empty), "stored_rows": F.coalesce("stored_rows", F.lit(0))})
            .drop("p"))


def diff_summary(changes: DataFrame, models: DataFrame, definitions: DataFrame) -> DataFrame:
    """Counts by severity and kind, as one row."""
    parts = [
        changes.select("severity", F.col("change").alias("kind")),
        models.filter("status <> 'changed'").select(F.lit("").alias("severity"), F.concat(F.lit("model_"), "status").alias("kind")),
        definitions.select("severity", F.concat(F.lit("def_"), "status").alias("kind"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    kind, severity = F.col("kind"), F.col("severity")
    return rows.agg(
        *[F.count_if(severity == s).alias(s) for s in ("breaking", "caution", "safe")],
        F.count_if(kind == "model_new").alias("models_added"), F.count_if(kind == "model_removed").alias("models_removed"),
        F.count_if(kind == "added").alias("fields_added"), F.count_if(kind == "removed").alias("fields_removed"),
        F.count_if(kind == "type_changed").alias("type_changes"),
        F.count_if(kind.isin("enum_added", "enum_removed")).alias("enum_changes"),
        *[F.count_if(kind == f"def_{s}").alias(f"defs_{s}") for s in ("added", "removed", "changed")])


def diff_impact(referenced: DataFrame, models: DataFrame, active: DataFrame) -> DataFrame:
    """Parsers, labels and issuers at risk, stored rows affected, active models hit."""
    risky = F.col("change").isin("removed", "type_changed")
    paths = referenced.filter(risky | (F.col("change") == "enum_removed"))
    facts = paths.select(F.when(F.col("has_parser"), F.col("field_path")).alias("parser"),
                         F.when(risky, F.col("labels")).alias("labels"), F.when(risky, F.col("issuers")).alias("issuers"),
                         F.when(risky, F.col("stored_rows")).otherwise(F.lit(0)).alias("stored_rows"))
    hit = models.filter("status IN ('changed', 'removed')").join(active, "model").select("model", "filings")
    both = facts.unionByName(hit.select(F.col("model").alias("active_model"), "filings"), allowMissingColumns=True)

    def flat(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return both.agg(
        F.array_sort(F.collect_set("parser")).alias("parsers_at_risk"), flat("labels").alias("labels_at_risk"),
        flat("issuers").alias("issuers_at_risk"), F.coalesce(F.sum("stored_rows"), F.lit(0)).alias("rows_affected"),
        F.array_sort(F.collect_set("active_model")).alias("active_models_affected"),
        F.coalesce(F.sum("filings"), F.lit(0)).alias("active_filings_affected"))


def pending_list(diffs: DataFrame) -> DataFrame:
    """Stored diffs, newest first."""
    return diffs.orderBy(F.desc("fetched_at"), "fetch_id")


def schema_status(docs: DataFrame, pending: DataFrame) -> DataFrame:
    """Id, version, content hash, models and pending diffs of each schema document."""
    models = model_entries(docs).groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "model"))), lambda r: r["model"]).alias("models"))
    waiting = pending.groupBy("doc_id").agg(F.count("*").alias("pending"), F.max("fetched_at").alias("last_fetched"))
    about = schema_versions(docs).join(docs.select("doc_id", content_hash(F.col("doc")).alias("content_hash")), "doc_id")
    return (about.join(models, "doc_id", "left").join(waiting, "doc_id", "left")
            .withColumn("pending", F.coalesce("pending", F.lit(0))))
