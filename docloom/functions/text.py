"""Column functions for Markdown and its cells: all built in, so they stay in generated code where Spark allows it.

Offsets count code points. White space in cells is the Unicode set that ECMAScript's ``\\s`` names.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "-"
#: White space (fixed values): ASCII, no-break space, Ogham, en quad to hair space, line and paragraph separator, narrow and medium spaces, ideographic, BOM.
SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# Patterns of the document format (fixed values): frontmatter block, heading line, inline link.
FRONTMATTER = r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"
HEADING_LINE = r"#{1,6}[ \t]+([^\n\r\x{2028}\x{2029}]+?)[ \t]*"
LINK = rf'\[[^\]]*\]\([{SPACE}]*([^){SPACE}]+)(?:[{SPACE}]+"[^"]*")?[{SPACE}]*\)'
MATCH_CAP = 20
FIND_WINDOW = 2000
SUMMARY_WIDTH = 120


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters they fold to."""
    found = []
    for cp in range(0xC0, 0x250):
        c = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and c.isalpha() and bare != c and len(bare) == 1:
            found.append((c, bare))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


MARKED, BARE = _folding()


def _vetted() -> str:
    """A character class of what the built-in tokenizer folds as NFKD does: ASCII, Latin letters, common punctuation."""
    held = {*range(0x80), *map(ord, MARKED + "ß¡¿«»§©®°±·×÷‐–—‘’“”„†•‹›€")}
    for cp in range(0xC0, 0x250):
        c = chr(cp)
        if len(c.lower()) == 1 and (c.lower() in MARKED or unicodedata.normalize("NFKD", c.lower()) == c.lower()):
            held.add(cp)
    starts = [c for c in sorted(held) if c - 1 not in held]
    ends = [c for c in sorted(held) if c + 1 not in held]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


UNVETTED = f"[^{_vetted()}]"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(value: Column, other: Column) -> Column:
    """``value``, or ``other`` where it is null or empty."""
    return let(value, lambda v: F.coalesce(F.when(v != "", v), other))


def strip_bom(source: Column) -> Column:
    return F.when(F.startswith(source, F.lit("\ufeff")), F.substr(source, F.lit(2))).otherwise(source)


def frontmatter_block(source: Column) -> Column:
    """The fenced head of ``source``, fences and all; empty if there is none."""
    return F.regexp_extract(source, FRONTMATTER, 0)


def frontmatter_parts(source: Column) -> Column:
    """The text between the fences (a carriage return at its end included) and what follows them; null or one element if there is no fenced head.

    The same as ``FRONTMATTER``, without a step of the pattern for each character.
    """
    opening = F.regexp_extract(source, r"\A---[ \t]*\r?\n", 0)
    return F.when(F.startswith(source, F.lit("---")), let(opening, lambda o: F.when(o != "", F.split(F.substr(source, F.length(o) + 1), r"\n---[ \t]*(?:\r?\n|\z)", 2))))


def frontmatter_text(source: Column) -> Column:
    return F.regexp_extract(source, FRONTMATTER, 1)


def body_of(source: Column) -> Column:
    return F.substr(source, F.length(frontmatter_block(source)) + 1)


def _beyond_ascii(value: Column) -> Column:
    """Whether a text holds more than letters, signs and plain blanks of ASCII: only then is the slow class of all white space needed."""
    return value.rlike("[^ -~]")


def flatten(value: Column) -> Column:
    return let(value, lambda v: F.btrim(F.when(F.contains(v, F.lit("  ")) | _beyond_ascii(v), F.regexp_replace(v, f"[{SPACE}]+", " ")).otherwise(v)))


def sanitize_cell(value: Column) -> Column:
    return filled(flatten(value), F.lit(EMPTY))


def slug(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_kind(value: Column) -> Column:
    return filled(slug(value), F.lit(EMPTY))


def slugify(heading: Column) -> Column:
    return F.coalesce(F.nullif(slug(heading), F.lit("")), F.lit("body"))


def truncate(value: Column, width: int = SUMMARY_WIDTH) -> Column:
    """At most ``width`` characters, cut at the last space if that is past the middle; an ellipsis marks the cut."""
    def cut(v: Column) -> Column:
        kept = F.regexp_replace(F.substring(v, 1, width), rf"\A([\s\S]{{{width // 2 + 1},}}) [^ ]*\z", "$1")
        return F.when(F.length(v) <= width, v).otherwise(F.concat(F.regexp_replace(kept, f"[{SPACE}]+\\z", ""), F.lit("…")))

    return let(value, cut)


def first_sentence(body: Column) -> Column:
    """The first sentence of the first line of prose outside closed code fences."""
    fenced = F.regexp_replace(body, r"(?m)(?<![^\n\r\x{2028}\x{2029}])```[\s\S]*?(?<=[\n\r\x{2028}\x{2029}])```[ \t]*(?![^\n\r\x{2028}\x{2029}])", "")
    prose = F.when(F.contains(body, F.lit("```")), fenced).otherwise(body)
    skipped = rf"\A[{SPACE}]*(?:\z|#|>|<!--|!\[|\||-{{3,}}|={{3,}})"
    lines = F.filter(F.split(prose, "\n"), lambda line: ~line.rlike(skipped))

    def cut(line: Column) -> Column:
        return _trim(filled(F.regexp_extract(line, rf"(?s)\A(.*?[.!?])(?:[{SPACE}]|\z)", 1), line))

    return let(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), cut)


def _trim(value: Column) -> Column:
    return let(value, lambda v: F.when(_beyond_ascii(v), F.regexp_replace(v, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")).otherwise(F.btrim(v)))


def derive_summary(description: Column, body: Column, width: int = SUMMARY_WIDTH) -> Column:
    return truncate(sanitize_cell(F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(first_sentence(body))), width)


def status_cell(status: Column) -> Column:
    cell = sanitize_cell(F.coalesce(status, F.lit("")))
    return F.when(F.lower(cell) == "current", F.lit(EMPTY)).otherwise(cell)


def stale_date(value: Column) -> Column:
    """``value`` if it looks like an ISO date, else empty."""
    return F.regexp_extract(_trim(F.coalesce(value, F.lit(""))), r"\A(\d{4}-\d{2}-\d{2})\z", 1)


def stale_demotion(status: Column, stale_after: Column, today: str) -> Column:
    return F.when((status == EMPTY) & (stale_after != "") & (stale_after < today), F.lit("stale")).otherwise(status)


def heading_title(body: Column) -> Column:
    """The first heading, unless a code fence opens before it."""
    before = F.regexp_extract(body, rf"\A((?:[\s\S]*?[\n\r\x{{2028}}\x{{2029}}])??){HEADING_LINE}(?:[\n\r\x{{2028}}\x{{2029}}]|\z)", 1)
    title = F.regexp_extract(body, rf"\A(?:[\s\S]*?[\n\r\x{{2028}}\x{{2029}}])??{HEADING_LINE}(?:[\n\r\x{{2028}}\x{{2029}}]|\z)", 1)
    return F.when(F.contains(before, F.lit("```")), F.lit("")).otherwise(flatten(title))


def link_targets(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(LINK), 1)


def resolve_target(target: Column, path: Column) -> Column:
    """The bundle path that ``target`` names in the document at ``path``; null for anchors, external and empty targets."""
    decoded = F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))
    # a sequence that is no UTF-8 decodes to replacement characters
    sound = lambda d: F.when(d.isNull() | (F.contains(d, F.lit("\ufffd")) & ~F.contains(target, F.lit("\ufffd"))), target).otherwise(d)
    plain = F.regexp_extract(F.when(F.contains(target, F.lit("%")), let(decoded, sound)).otherwise(target), r"\A([^#?]*)", 1)
    empty = F.array().cast("array<string>")

    def walk(p: Column) -> Column:
        folder = F.when(p.startswith("/"), F.lit("")).otherwise(F.regexp_extract(path, r"\A(.*/)?[^/]*\z", 1))
        step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
        named = lambda j: F.when(j.rlike(r"(?i)\.md\z"), j).otherwise(F.concat(j, F.lit(".md")))
        return F.when(p != "", let(F.array_join(F.aggregate(F.split(F.concat(folder, p), "/"), empty, step), "/"), named))

    outside = target.startswith("#") | target.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:")
    return F.when(~outside, let(plain, walk))


def tokens(text: Column) -> Column:
    """Search terms of a vetted text: lower case, marks of Latin letters dropped, runs of letters and digits."""
    low = F.lower(text)
    folded = F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, MARKED, BARE)).otherwise(low)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), 0)


def is_vetted(text: Column) -> Column:
    # what isn't ASCII is a small part of most texts: only that is held against the class
    return ~F.regexp_replace(text, r"[\x00-\x7f]+", "").rlike(UNVETTED)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def is_concept_path(path: Column) -> Column:
    return ~F.lower(F.substring_index(path, "/", -1)).isin("index.md", "log.md") & path.rlike(r"(?i)\.md\z")


def has_dot_segment(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.")


def is_valid_path(path: Column) -> Column:
    """Relative, at most 200 characters, ``.md``, every segment of letters, digits, dots, underscores and hyphens, beginning with one of the first two."""
    return (F.length(path) <= 200) & path.rlike(r"(?i)\A[a-z0-9][a-z0-9._-]*(?:/[a-z0-9][a-z0-9._-]*)*\z") & path.rlike(r"(?i)\.md\z")


def is_valid_name(name: Column) -> Column:
    return name.rlike(r"(?i)\A[a-z0-9][a-z0-9_-]{0,63}\z")


def content_hash(source: Column) -> Column:
    return F.sha2(source.cast("binary"), 256)


def folds(text: Column) -> Column:
    """Whether lower-casing keeps all offsets."""
    return F.length(F.lower(text)) == F.length(text)


def find_offsets(text: Column, needle: str) -> Column:
    """Offsets of all occurrences of ``needle`` that don't overlap, regardless of case where that moves no offset."""
    fold = folds(text) & F.lit(len(needle.lower()) == len(needle))
    phrase = F.when(fold, F.lit(needle.lower())).otherwise(F.lit(needle))
    pieces = F.split(F.when(fold, F.lower(text)).otherwise(text), F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, piece: F.struct((s["at"] + F.length(piece) + len(needle)).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(piece))).alias("all"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["all"])


def slice_of(text: Column, offset: int = 0, limit: int | None = None) -> Column:
    """``{text, start, end, total}`` of a window, clamped to the text."""
    total = F.length(text)
    start = F.least(F.lit(max(0, int(offset))), total)
    end = total if limit is None else F.least(total, start + max(0, int(limit)))
    return F.struct(F.substr(text, start + 1, end - start).alias("text"), start.alias("start"), end.alias("end"), total.alias("total"))


def find_slice(text: Column, offsets: Column, needle_length: int, limit: int = FIND_WINDOW) -> Column:
    """``{text, start, end, total, matches, match_count}`` of the window around the first match."""
    total, first, limit = F.length(text), F.get(offsets, F.lit(0)), max(0, int(limit))
    half = max(0, limit - needle_length) // 2
    end = F.when(F.size(offsets) > 0, F.least(total, F.greatest(F.lit(0), first - half) + limit)).otherwise(F.lit(0))
    start = F.greatest(F.lit(0), end - limit)
    return F.struct(F.substr(text, start + 1, end - start).alias("text"), start.alias("start"), end.alias("end"), total.alias("total"), F.slice(offsets, 1, MATCH_CAP).alias("matches"), F.size(offsets).alias("match_count"))


def frame(id_: Column, s: Column, found: bool = False) -> Column:
    """The line above a slice that says what part of the text it is."""
    partial = (s["start"] > 0) | (s["end"] < s["total"])
    span = F.when(partial, F.format_string(" [%d..%d of %d]", s["start"], s["end"], s["total"])).otherwise(F.lit(""))
    if not found:
        return F.concat(F.lit("@@ "), id_, span)
    n = s["match_count"]
    count = F.when(n > F.size(s["matches"]), F.format_string("first %d of %d", F.size(s["matches"]), n)).otherwise(n.cast("string"))
    word = F.when(n == 1, F.lit("match")).otherwise(F.lit("matches"))
    hit = F.concat(F.lit("@@ "), id_, span, F.lit(" "), count, F.lit(" "), word, F.lit(" at "), F.array_join(F.transform(s["matches"], lambda x: x.cast("string")), " "))
    return F.when(n == 0, F.concat(F.lit("@@ "), id_, F.format_string(" no match in %d chars", s["total"]))).otherwise(hit)
