"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Han ranges, and the patterns of text that is not prose.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{31350}-\x{323AF}"
SPACE = r"\s\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}"
DATA_URIS = [
    r"""(?is)<img\b[^>]*\bsrc=["']\s*data:image/[a-z0-9.+-]+;base64,[^"']+["'][^>]*>""",
    r"""(?is)!\[[^\]]*\]\(\s*data:image/[a-z0-9.+-]+;base64,[^)]+\)""",
    r"""(?i)data:image/[a-z0-9.+-]+;base64,[a-z0-9+/=]{200,}""",
    r"""(?i)data:[a-z0-9.+/-]+;base64,[a-z0-9+/=]{200,}""",
]
MATCH_TYPES = {0: "Vector Match", 1: "Keyword Match", 2: "Adjacent Chunk Match", 3: "History Match", 4: "Parent Chunk Match", 5: "Relation Chunk Match", 6: "Graph Match"}
WORD_ENDS = r"""[ \t\n\r,.;:?!()\[\]{}"']"""
EMBED_LIMIT = 20_000


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalised(text: Column) -> Column:
    """Lower case, every run of white space as one space, none at the ends."""
    return F.lower(stripped(F.regexp_replace(text, rf"[{SPACE}]+", " ")))


def signature(text: Column) -> Column:
    """MD5 of the normalised text; empty for a blank one."""
    n = normalised(text)
    return F.when(n == "", F.lit("")).otherwise(F.md5(n))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda x: x != "")


def cjk_terms(text: Column) -> Column:
    """Runs between white space, punctuation and symbols; runs of Han as their overlapping pairs, a single one as it is."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{HAN}]+|[^\p{{P}}\p{{S}}{SPACE}{HAN}]+"), 0)
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda run: F.when(run.rlike(rf"^[{HAN}]{{2,}}$"), pairs(run)).otherwise(F.array(run))))


def token_set(text: Column) -> Column:
    """Distinct lower-case words of two characters or more that are not all punctuation; Han texts give pairs."""
    low = F.lower(text)
    words = F.when(low.rlike(r"[\x{4E00}-\x{9FFF}]"), cjk_terms(low)).otherwise(split_words(low))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & w.rlike(r"[\p{L}\p{N}]")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared tokens against the smaller set; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def contained(short: Column, long: Column) -> Column:
    """Whether a normalised text lies within another; empty ones never do."""
    return (short != "") & (long != "") & F.contains(long, short)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(clamp(x, 0.0, 1.0))


def sanitised_for_embedding(text: Column) -> Column:
    """Base64 payloads as [image], at most EMBED_LIMIT characters."""
    clean = text
    for pattern in DATA_URIS:
        clean = F.regexp_replace(clean, pattern, "[image]")
    return F.substring(F.when(F.contains(text, F.lit("base64,")), clean).otherwise(text), 1, EMBED_LIMIT)


def clean_utf8(text: Column) -> Column:
    """Without NUL; what is not valid UTF-8, such as a lone surrogate, goes, and a replacement character that was there stays."""
    kept = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    return F.replace(kept, F.lit("\0"), F.lit(""))


def storage_size(text: Column) -> Column:
    return F.octet_length(text) + 200


# Patterns of a passage's marks with what stands for them, before and after table rows are read; group n is $n.
_URL = r"[^()\s]*(?:\([^)]*\)[^()\s]*)*"
CLEAN = [
    (r"(?s)```\w*\n?.*?```", ""),
    (r"(?s)\$\$.*?\$\$", ""),
    (r"</?[a-zA-Z][^>]*>", ""),
    (rf"\[!\[([^\]]*)\]\(({_URL})\)\]\({_URL}\)", "![$1]($2)"),
    (rf"!\[[^\]]*\]\({_URL}\)", ""),
    (rf"\[([^\]]+)\]\({_URL}\)", "$1"),
    (r"https?://[^\s)\]>]+", ""),
    (r"(?m)^[ \t]*\|[ \t:|-]+\|[ \t]*$", ""),
]
CLEAN_LAST = [(r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"\*{3}(.+?)\*{3}", "$1"), (r"\*{2}(.+?)\*{2}", "$1"), (r"\*(.+?)\*", "$1"), (r"(?m)^[\t ]*(?:[-*+]|\d+\.)\s+", ""), (r"\n{3,}", "\n\n")]


def clean_passage(text: Column) -> Column:
    """Prose of a Markdown passage: without code, formulas, tags, images, urls, marks and table rules; rows as lists."""
    for pattern, by in CLEAN:
        text = F.regexp_replace(text, pattern, by)
    row = lambda x: F.array_join(F.filter(F.transform(F.split(F.regexp_extract(x, r"^[ \t]*\|(.+?)\|[ \t]*$", 1), r"\|"), stripped), lambda c: c != ""), ", ")
    text = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"^[ \t]*\|.+?\|[ \t]*$"), row(x)).otherwise(x)), "\n")
    for pattern, by in CLEAN_LAST:
        text = F.regexp_replace(text, pattern, by)
    return stripped(text)


def enriched_passage(content: Column, image_info: Column, metadata: Column) -> Column:
    """The clean passage with what its images and its generated questions say, from their JSON."""
    images = F.from_json(image_info, "array<struct<caption string, ocr_text string>>")
    seen = F.flatten(F.transform(images, lambda i: F.array(i["caption"], i["ocr_text"])))
    questions = F.from_json(metadata, "struct<generated_questions: array<struct<question: string>>>")["generated_questions"]["question"]
    asked = F.array_join(F.filter(questions, lambda q: q.isNotNull() & (q != "")), "; ")
    more = F.array_join(F.filter(F.concat(F.coalesce(seen, F.array()), F.array(F.coalesce(asked, F.lit("")))), lambda x: x.isNotNull() & (x != "")), "\n")
    base = clean_passage(content)
    return F.when(more == "", base).when(base == "", more).otherwise(F.concat(base, F.lit("\n\n"), more))


def embedding_text(title: Column, header: Column, content: Column) -> Column:
    """[title, line feed] [header, blank line] content, each without white space at its ends."""
    body = stripped(content)
    head = stripped(F.coalesce(header, F.lit("")))
    with_head = F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))
    name = stripped(F.coalesce(title, F.lit("")))
    return F.when(name == "", with_head).otherwise(F.concat(name, F.lit("\n"), with_head))


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def relevance_level(score: Column) -> Column:
    return F.when(score >= 0.8, "High Relevance").when(score >= 0.6, "Medium Relevance").when(score >= 0.4, "Low Relevance").otherwise("Weak Relevance")


def match_type_name(kind: Column) -> Column:
    out = F.concat(F.lit("Unknown Type("), kind.cast("string"), F.lit(")"))
    for k, name in MATCH_TYPES.items():
        out = F.when(kind == k, F.lit(name)).otherwise(out)
    return out


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters, the last three of a cut text being dots."""
    cut = F.substring(text, 1, limit) if limit <= 3 else F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def head_and_tail(text: Column, limit: int = 16_000, reserve: int = 200) -> Column:
    """Texts over the limit as 7 parts of the start and 3 of the end, with a note in between that the reserve is for."""
    room = limit - reserve
    head = int(room * 0.7)
    note = F.concat(F.lit("\n\n... [output truncated: "), F.length(text).cast("string"), F.lit(f" \u2192 {limit} chars, showing first {head} + last {room - head}] ...\n\n"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(room - head))) if room > 0 else F.substring(text, 1, limit))


def query_words(query: Column) -> Column:
    """Distinct lower-case words of two characters or more of a query."""
    return F.array_distinct(F.filter(F.transform(F.split(query, WORD_ENDS), lambda x: F.lower(stripped(x))), lambda x: F.length(x) >= 2))


def snippet(text: Column, words: Column, around: int = 200) -> Column:
    """The earliest of the words in a text between dots, with at most so many characters on either side; else its start."""
    body = stripped(text)
    low = F.lower(body)
    places = F.filter(F.transform(words, lambda w: F.struct(F.position(w, low).alias("at"), F.length(w).alias("n"))), lambda p: p["at"] > 0)
    at, n = F.array_min(places)["at"], F.try_element_at(F.filter(places, lambda p: p["at"] == F.array_min(F.transform(places, lambda q: q["at"]))), F.lit(1))["n"]
    begin = F.greatest(at - around, F.lit(1))
    cut = F.regexp_replace(F.replace(F.substring(body, begin, at - begin + n + around), F.lit("\n"), F.lit(" ")), " {2,}", " ")
    start = F.when(F.length(body) > 2 * around, F.concat(stripped(F.substring(body, 1, 2 * around)), F.lit(" ..."))).otherwise(body)
    return F.when(F.size(places) > 0, F.concat(F.lit("... "), stripped(cut), F.lit(" ..."))).otherwise(start)


#: Characters on either side of a match, of a match, and of a whole snippet.
AROUND, MATCHED, SHOWN = 200, 200, 800


def regex_snippet(text: Column, patterns: list[str]) -> Column:
    """The earliest match of any pattern between dots, with what stands around it in one line; empty without a match."""
    first = lambda p: F.when(text.rlike(p), F.struct(F.length(F.element_at(F.split(text, p, 2), 1)).alias("at"), F.regexp_extract(text, p, 0).alias("m")))
    places = F.filter(F.array(*[first(p) for p in patterns]), lambda x: x.isNotNull())
    least = F.array_min(F.transform(places, lambda x: x["at"]))
    best = F.try_element_at(F.filter(places, lambda x: x["at"] == least), F.lit(1))
    at, m = best["at"], best["m"]
    begin = F.greatest(at - AROUND, F.lit(0))
    shown = F.when(F.length(m) > MATCHED, F.concat(F.substring(m, 1, MATCHED), F.lit("..."))).otherwise(m)
    line = F.concat(F.substring(text, begin + 1, at - begin), shown, F.substring(text, at + F.length(m) + 1, F.lit(AROUND)))
    line = stripped(F.regexp_replace(F.replace(line, F.lit("\n"), F.lit(" ")), " {2,}", " "))
    cut = F.when(F.length(line) > SHOWN, F.concat(F.substring(line, 1, SHOWN), F.lit("..."))).otherwise(line)
    return F.when(F.size(places) > 0, F.concat(F.lit("... "), cut, F.lit(" ..."))).otherwise(F.lit(""))


def closed_up(text: Column) -> Column:
    """Without spaces after or before anything but Latin letters, digits and the marks that a space may follow or precede."""
    after = F.regexp_replace(text, r"(?i)([^a-z0-9.,)>]) +([^ ])", "$1$2")
    return F.regexp_replace(after, r"(?i)([^ ]) +([^a-z0-9.,(<])", "$1$2")


def newest(line: Column, number: bool = False) -> Column:
    """The greatest of all lines but ``nan`` as times (text), 1970 if there is none; or as numbers, 0 if there is none."""
    kept = F.when(line != "nan", line)
    return F.greatest(F.coalesce(F.max(kept.cast("long")), F.lit(0)), F.lit(0)) if number else F.greatest(F.coalesce(F.max(kept), F.lit("")), F.lit("1970-01-01 00:00:00"))


def message_tokens(*parts: Column) -> Column:
    """A quarter of the characters of all parts joined by line feeds, rounded up, and 8."""
    return F.floor((F.length(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])) + 3) / 4) + 8


def image_urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), 2))


def file_size(size: Column) -> Column:
    """Bytes, KB, MB or GB, the latter with two decimals."""
    show = lambda shift, name: F.concat(F.format_string("%.2f", size / float(1 << shift)), F.lit(f" {name}"))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, show(10, "KB")).when(size < 1 << 30, show(20, "MB")).otherwise(show(30, "GB"))


def summary(text: Column, limit: int) -> Column:
    """One line of at most limit characters; a dash for a blank text."""
    line = F.regexp_replace(F.replace(F.replace(stripped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), r"\s+", " ")
    return F.when(line == "", F.lit("-")).when(F.length(line) <= limit, line).otherwise(F.concat(stripped(F.substring(line, 1, limit)), F.lit("...")))
