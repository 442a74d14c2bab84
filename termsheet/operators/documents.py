"""Text windows over filing documents.

Documents are megabytes each, so every operator here is a projection: the text never goes
through a shuffle, and wide columns are cut down before anything is exploded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from termsheet import config
from termsheet.functions.html import image_sources, strip_html
from termsheet.functions.text import let, strip

_MARK = "\u0001"


def plain_text(pages: DataFrame) -> DataFrame:
    """H1: visible text and its length."""
    return pages.withColumn("text", strip_html(F.col("html"))).withColumn("char_count", F.length("text"))


def cover(text: Column, chars: int = config.COVER_CHARS) -> Column:
    """H4: the first characters of the document."""
    return F.substring(text, 1, chars)


def key_terms_window(docs: DataFrame, headings: Column | None = None,
                     anchors: list[str] = config.KEY_TERMS_ANCHORS,
                     window: int = config.KEY_TERMS_WINDOW,
                     lead_in: int = config.KEY_TERMS_LEAD_IN) -> DataFrame:
    """H5: a window from shortly before the earliest anchor, else the head of the text.

    ``headings`` is an array Column of issuer headings tried along with the shared anchors;
    matching is case-sensitive.
    """
    fixed = F.array(*[F.lit(a) for a in anchors])
    every = fixed if headings is None else F.concat(
        F.coalesce(headings, F.array().cast("array<string>")), fixed)
    hits = F.filter(F.transform(every, lambda a: F.position(a, F.col("text"))), lambda p: p > 0)
    found = docs.withColumn("anchor", F.array_min(hits))
    start = F.coalesce(F.greatest(F.col("anchor") - lead_in, F.lit(1)), F.lit(1))
    return (found.withColumn("window_text", F.substring("text", start, F.lit(window)))
            .withColumn("was_trimmed", F.col("anchor").isNotNull()).drop("anchor"))


def issuer_headings(issuer_key: Column, issuers: list[dict] = config.ISSUERS) -> Column:
    """Array of the issuer's section headings, null for other issuers."""
    return F.coalesce(*[F.when(issuer_key == i["issuer_key"], F.array(*[F.lit(h) for h in i["headings"]]))
                        for i in issuers])


def section_slices(docs: DataFrame, sections: dict = config.SECTIONS,
                   routes: dict[str, list[str]] | None = config.MODEL_SECTIONS,
                   default: list[str] | None = None,
                   lead_in: int = config.SECTION_LEAD_IN) -> DataFrame:
    """H6: one text slice per (document, section of its model).

    ``identifiers`` is the head of the text; any other section starts a little before the
    earliest of its headers, found as a whole word in any case by one scan; no header gives an
    empty slice.  Slices are cut inside the document row and only they are exploded.
    ``docs`` needs ``model`` unless ``routes`` is None, which runs every section.
    """
    order = list(sections) if default is None else default

    def cut(name: str) -> Column:
        spec = sections[name]
        size = F.lit(spec["max_chars"])
        if name == "identifiers":
            return F.substring("text", F.lit(1), size)
        words = "|".join(re.escape(h) for h in spec["search_headers"])
        start = F.regexp_instr("text", F.lit(rf"(?iU)\b(?:{words})\b"))
        return let(start, lambda p: F.when(p > 0, F.substring(
            F.col("text"), F.greatest(p - lead_in, F.lit(1)), size)).otherwise(F.lit("")))

    def wanted(name: str) -> Column:
        if routes is None:
            return F.lit(True)
        by_model = [F.when(F.col("model") == m, F.lit(name in r)) for m, r in routes.items()]
        return F.coalesce(*by_model, F.lit(name in order))

    rows = F.array(*[F.when(wanted(name), F.struct(
        F.lit(name).alias("section"), F.lit(i).alias("ord"), cut(name).alias("slice")))
        for i, name in enumerate(sections)])
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.inline(F.array_compact(rows)))


def split_short_slices(slices: DataFrame, minimum: int = config.MIN_SLICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """H7: slices worth a request, and the skipped ones."""
    return (slices.filter(F.length("slice") >= minimum),
            slices.filter(F.length("slice") < minimum).drop("slice"))


def targeted_sections(text: Column, words: list[str] = config.FEATURE_WORDS,
                      lead_in: int = config.TARGET_LEAD_IN, window: int = config.TARGET_WINDOW,
                      cap: int = config.TARGET_CAP, joiner: str = config.TARGET_JOINER) -> Column:
    """H8: context around every feature word; overlapping windows merged; total length capped.

    Two windows merge exactly when the text between their words is no longer than ``lead_in +
    window``.  So the text between consecutive words decides: a short stretch is kept whole, a
    long one keeps its first ``window`` and last ``lead_in`` characters with a cut in between.
    """
    pattern = "(?iU)" + "|".join(re.escape(w) for w in words)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def tail(part: Column) -> Column:
        return F.substring(part, F.greatest(F.length(part) - lead_in + 1, F.lit(1)), F.length(part))

    def keep(part: Column, i: Column, last: Column) -> Column:
        head = F.substring(part, 1, window)
        inner = F.when(F.length(part) <= lead_in + window, part).otherwise(
            F.concat(head, F.lit(_MARK), tail(part)))
        return F.when(i == 0, tail(part)).when(i == last, head).otherwise(inner)

    def stitch(parts: Column) -> Column:
        kept = F.transform(parts, lambda p, i: keep(p, i, F.size(parts) - 1))
        glued = F.zip_with(kept, hits, lambda k, h: F.concat(k, F.coalesce(h, F.lit(""))))
        return F.transform(F.split(F.array_join(glued, ""), _MARK), strip)

    def add(state: Column, chunk: Column) -> Column:
        room = F.lit(cap) - state["total"]
        cut = F.substring(chunk, F.lit(1), room)
        return F.when(room > 0, F.struct(
            (state["total"] + F.length(cut)).alias("total"),
            F.concat(state["out"], F.array(cut)).alias("out"))).otherwise(state)

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(let(between, stitch), start, add, lambda s: F.array_join(s["out"], joiner))
    return F.when(text.rlike(pattern), joined).otherwise(F.lit(""))


def _quoted(needle: Column, space: str) -> Column:
    """A pattern for the needle in which any run of white space matches ``space``."""
    safe = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    spaced = F.regexp_replace(safe, r"(?U)\s+", "\\\\E" + space.replace("\\", "\\\\") + "\\\\Q")
    return F.concat(F.lit("(?U)\\Q"), spaced, F.lit("\\E"))


def _exact(text: Column, needle: Column) -> Column:
    return let(F.position(needle, text), lambda p: F.when(p > 0, F.struct(
        p.alias("start"), F.length(needle).alias("length"))))


def _flexible(text: Column, needle: Column, space: str) -> Column:
    return let(_quoted(needle, space), lambda pattern: let(
        F.regexp_instr(text, pattern), lambda p: F.when(p > 0, F.struct(
            p.alias("start"), F.length(F.regexp_substr(text, pattern)).alias("length")))))


def anchor_excerpt(text: Column, excerpt: Column) -> Column:
    """H9: struct<start, length> of an excerpt in its text (1-based), null if not found.

    Prefixes of 100, 85, ... 25 characters (from the excerpt's length if shorter, at least 20)
    are tried in turn, each as it stands and then with flexible white space; the first hit ends
    the search.
    """
    longest = F.least(F.length(excerpt), F.lit(100))
    sizes = F.when(longest >= 20, F.sequence(longest, F.lit(20), F.lit(-15)))
    none = F.lit(None).cast("struct<start:int,length:int>")
    return F.aggregate(sizes, none, lambda hit, n: F.when(hit.isNotNull(), hit).otherwise(
        let(F.substring(excerpt, F.lit(1), n), lambda needle: F.coalesce(
            _exact(text, needle), _flexible(text, needle, r"\s+")))))


_GAP = 10
_HIT = "struct<start:int,back:int,end:int>"


def _gapped(text: Column, excerpt: Column) -> Column:
    """The first place where the words of an excerpt stand with gaps of up to 10 characters, each as long as it can be.

    What a regular expression finds, but in steps: a word has few places, and of each only the best way on to the end is
    kept, so texts that repeat themselves cost no more than their places.  Words are taken from the last to the first.
    Signs have four bytes here, so a place is reached at once.
    """
    def find(wide: Column, words: Column) -> Column:
        last = F.get(words, F.size(words) - 1)
        size = lambda word: F.length(word).cast("int")                             # noqa: E731
        total = (F.length(wide) / 4).cast("int")

        def stands(word: Column, at: Column) -> Column:
            return (at >= 1) & (F.substring(wide, at * 4 - 3, size(word)) == word)

        ends = F.transform(F.filter(F.sequence(F.lit(1), total + 1), lambda p: stands(last, p)), lambda p: F.struct(
            p.alias("start"), (-p).alias("back"), (p + (size(last) / 4).cast("int")).alias("end")))

        def before(found: Column, word: Column) -> Column:
            chars = (size(word) / 4).cast("int")
            ways = F.flatten(F.transform(found, lambda f: F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(_GAP)), lambda gap: F.struct(
                    (f["start"] - gap - chars).alias("start"), (-f["start"]).alias("back"), f["end"].alias("end"))),
                lambda way: stands(word, way["start"]))))
            # Of equal places the first one has the longest gap.
            return let(F.array_sort(ways), lambda all_: F.filter(all_, lambda way, i: (i == 0) | (
                way["start"] != F.get(all_, F.greatest(i - 1, F.lit(0)))["start"])))

        first = F.aggregate(F.slice(F.reverse(words), F.lit(2), F.size(words)), ends.cast(f"array<{_HIT}>"),
                            lambda found, word: F.when(F.size(found) == 0, found).otherwise(before(found, word)))
        return let(F.get(first, F.lit(0)), lambda hit: F.when(hit.isNotNull(), F.struct(
            hit["start"].alias("start"), F.nullif(hit["end"] - hit["start"], F.lit(0)).alias("length"))))

    words = F.split(excerpt, r"(?U)\s+", -1)
    wide = lambda c: F.encode(c, "UTF-32")                                          # noqa: E731
    return let(words, lambda all_: F.when(F.forall(all_, lambda word: text.contains(word)), let(
        F.struct(wide(text).alias("text"), F.transform(all_, wide).alias("words")), lambda w: find(w["text"], w["words"]))))


def anchor_excerpt_loose(text: Column, excerpt: Column) -> Column:
    """Exact, then white space as any gap of up to 10 characters, then a 40-character prefix."""
    prefix = F.when(F.length(excerpt) > 40, _exact(text, F.substring(excerpt, 1, 40)))
    return F.when(F.length(excerpt) >= 5, F.coalesce(_exact(text, excerpt), _gapped(text, excerpt), prefix))


def history_window(turns: DataFrame, current: DataFrame, keep: int = config.HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation, from a user turn on, and then the new message.

    ``turns`` is (conv_id, turn, role, text), ``current`` (conv_id, text).  The rank filter lets
    Spark cut each conversation to ``keep`` rows before the shuffle.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= keep)
    size = F.max("back").over(Window.partitionBy("conv_id"))
    kept = (recent.withColumn("oldest", size)
            .filter((F.col("back") < F.col("oldest")) | (F.col("role") == "user"))
            .select("conv_id", (-F.col("back")).alias("pos"), "role", "text"))
    return kept.unionByName(current.select("conv_id", F.lit(0).alias("pos"), F.lit("user").alias("role"), "text"))


def filing_images(pages: DataFrame, base: Column, limit: int = config.MAX_IMAGES,
                  extensions: list[str] = config.IMAGE_EXTENSIONS) -> DataFrame:
    """Names of the images to fetch for each filing, in document order.

    Inline and blank sources are skipped, relative ones resolved against ``base``; only files of
    the filing's own folder with an image extension (or none) count, each name once.
    """
    def resolve(src: Column) -> Column:
        absolute = src.rlike("^https?://")
        return F.when((src != "") & ~src.startswith("data:"), F.when(absolute, src).otherwise(
            F.concat(base, F.ltrim(src, F.lit("/")))))

    urls = F.filter(F.transform(image_sources(F.col("html")), resolve), lambda u: u.contains(base))
    names = F.transform(urls, lambda u: F.substring_index(F.substring_index(u, "/", -1), "?", 1))

    def wanted(name: Column) -> Column:
        suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
        return (name != "") & ((suffix == "") | suffix.isin(extensions))

    chosen = F.slice(F.array_distinct(F.filter(names, wanted)), 1, limit)
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, F.posexplode(chosen).alias("ord", "image_name"))
