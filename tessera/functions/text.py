"""Text expressions: normal forms, tokens, overlaps, sentences, slices, decoded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokens leave out.
STOP_WORDS = (
    "this", "that", "with", "from", "into", "than", "then", "when", "where", "which", "while", "would",
    "should", "must", "have", "has", "been", "were", "will", "each", "every", "only", "also", "such",
    "public", "private", "static", "readonly", "sealed", "class", "namespace", "using", "return", "async",
    "await", "task", "string", "decimal", "double", "bool", "void", "null", "true", "false", "value",
    "order", "service", "stage", "result", "context", "state", "record", "field", "fields", "output",
    "input", "section", "services", "platform", "desk", "client", "account", "number", "whole", "exactly",
)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal(text: Column) -> Column:
    """Lower-case letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def tokens(text: Column) -> Column:
    """Lower-case parts of identifiers, split at case changes: four letters or more, no stop word, not all digits."""
    return F.filter(token_parts(text), lambda t: ~t.isin(*STOP_WORDS))


def token_parts(text: Column) -> Column:
    """Tokens, stop words among them: a space between cases, then one pass that takes parts of four or more."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z][A-Za-z0-9]{3,}"), F.lit(0)), lambda t: F.lower(t))


TERM = "[A-Za-z][A-Za-z0-9_-]+"


def terms(text: Column) -> Column:
    """Lower-case retrieval terms."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences with their terminators."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.?!]+[.?!]"), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) > 1)


def questions(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: s.endswith("?"))


def clean_transcript(text: Column) -> Column:
    """Nothing where a text is one bracketed remark."""
    t = F.trim(text)
    return F.when((t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")")), "").otherwise(t)


def first_difference(a: Column, b: Column) -> Column:
    """Index from 0 of the first differing character; the shorter length where one text begins the other; -1 where equal."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(a == b, -1).otherwise((at - 1).cast("int"))


def fenced_body(text: Column) -> Column:
    """The content of the first code fence, or the text."""
    inner = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", "")


def trailing_sign_number(text: Column, scale: int = 2) -> Column:
    """A number with implied decimals and its sign last, such as 00001582+."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    size = digits.cast("decimal(18,0)") / F.lit(10**scale)
    return (F.when(F.trim(text).endswith("-"), -size).otherwise(size)).cast(f"decimal(18,{scale})")


def hex_normal(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(text, "(?i)0x", ""), "[^0-9A-Fa-f]", ""))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.0)


def expand_name(name: Column, words: dict[str, str]) -> Column:
    """Hyphenated parts spelled out by a map, others capitalised."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(F.split(F.lower(name), "-"), lambda p: F.coalesce(F.get(F.transform(F.array(p), lambda q: table[q]), 0), F.initcap(p))), " ")


def top_level_commas(text: Column) -> Column:
    """Parts between commas that no parenthesis encloses, at any depth; a text that ends in such a comma has no part after it."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, c: Column) -> Column:
        cuts = (c == ",") & (s["depth"] == 0)
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cuts, "").otherwise(F.concat(s["now"], c)).alias("now"), F.when(cuts, F.array_append(s["parts"], s["now"])).otherwise(s["parts"]).alias("parts"))

    end = lambda s: F.transform(F.when(s["now"] != "", F.array_append(s["parts"], s["now"])).otherwise(s["parts"]), lambda p: F.trim(p))
    return F.aggregate(F.split(text, ""), start, step, end)


def prettify(name: Column) -> Column:
    """Parts between underscores and hyphens, each of two letters or more with a capital first and the rest in lower case."""
    return F.array_join(F.transform(F.split(name, "[_-]"), lambda p: F.when(F.length(p) <= 1, p).otherwise(F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30))))), " ")


def number_after(text: Column, marker: str) -> Column:
    """The leading digits after the first `marker` of a line, of the first line where they make an integer; 0 if none does."""
    with_it = F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit(marker)))
    found = F.transform(with_it, lambda line: F.regexp_extract(F.substr(line, F.locate(marker, line) + len(marker)), r"^[0-9]+", 0).try_cast("int"))
    return F.coalesce(F.get(F.array_compact(found), 0), F.lit(0))


def hex_after(line: Column, marker: str) -> Column:
    """The leading hexadecimal digits after the first `marker`, in upper case; empty if there are none."""
    at = F.locate(marker, line)
    return F.when(at > 0, F.upper(F.regexp_extract(F.substr(line, at + len(marker)), r"^[0-9A-Fa-f]*", 0))).otherwise("")


def json_body(text: Column) -> Column:
    """The first code fence's content, or the text, from its first brace to its last."""
    t = fenced_body(text)
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(t)


# How the fields of a streamed trace are read aloud, those after a comma first.
TRACE_FIELDS = (
    ('{"trace":', ""), (',"sequence":', " step "), ('"sequence":', "step "), (',"stage":', " · "), ('"stage":', ""),
    (',"evidence":', " — quoting: "), ('"evidence":', " — quoting: "), (',"decision":', " — decided: "), ('"decision":', " — decided: "),
)


def humanise_fragment(text: Column, most: int = 400) -> Column:
    """A fragment of a streamed JSON trace as prose; of a longer one the last `most` characters."""
    t = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))
    for field, prose in TRACE_FIELDS:
        t = F.replace(t, F.lit(field), F.lit(prose))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r'[{}\[\]"]', ""), " {2,}", " "))
    t = F.trim(F.regexp_replace(t, r"^[·, ]+", ""))
    return F.when(F.length(t) > most, F.concat(F.lit("…"), F.right(t, F.lit(most)))).otherwise(t)


def split_assumptions(content: Column) -> Column:
    """(body, assumptions): lines `// ASSUMPTION:` and the comment lines that go on with one, and the other lines but `// FILE:`.

    A code fence around the content goes first.
    """
    t = F.regexp_replace(content, r"^\s+|\s+$", "")
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)```", 1)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("assumptions"), F.array().cast("array<string>").alias("body"))

    def step(s: Column, line: Column) -> Column:
        cut = F.regexp_replace(line, r"^\s+", "")
        opens, names = F.upper(cut).startswith("// ASSUMPTION:"), F.upper(cut).startswith("// FILE:")
        goes_on = ~opens & s["inside"] & cut.startswith("//") & ~cut.startswith("///")
        last = F.concat(F.element_at(s["assumptions"], -1), F.lit(" "), F.trim(F.regexp_replace(cut, "^/+", "")))
        assumptions = F.when(opens, F.array_append(s["assumptions"], F.trim(F.substr(cut, F.lit(15))))).when(goes_on, F.array_append(F.slice(s["assumptions"], F.lit(1), F.size(s["assumptions"]) - 1), last)).otherwise(s["assumptions"])
        inside = F.when(opens, True).when(goes_on | names, s["inside"]).otherwise(False)
        body = F.when(opens | goes_on | names, s["body"]).otherwise(F.array_append(s["body"], F.regexp_replace(line, r"\s+$", "")))
        return F.struct(inside.alias("inside"), assumptions.alias("assumptions"), body.alias("body"))

    # an index below 1 is never reached: a line goes on only where there is an assumption
    trimmed = lambda lines: F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
    return F.aggregate(F.split(F.when(inner != "", inner).otherwise(t), "\n"), start, step, lambda s: F.struct(trimmed(s["body"]).alias("body"), s["assumptions"].alias("assumptions")))


def formatted(value: Column, kind: str) -> Column:
    """A number as money, percent, integer, boolean or plain number, as a policy prints it."""
    plain = lambda v: F.regexp_replace(F.regexp_replace(v.cast("decimal(38,4)").cast("string"), r"0+$", ""), r"\.$", "")
    if kind == "money":
        return F.concat(F.when(value < 0, "-$").otherwise("$"), F.format_number(F.abs(value), 2))
    if kind == "percent":
        return F.concat(plain(value * 100), F.lit("%"))
    if kind == "boolean":
        return F.when(value != 0, "true").otherwise("false")
    return value.cast("decimal(38,0)").cast("string") if kind == "integer" else plain(value)


def topic(stage: Column) -> Column:
    """The name of a stage's topic."""
    return F.concat_ws(".", F.lit("orders"), stage, F.lit("v1"))


def all_allowed(cited: Column, allowed: Column) -> Column:
    """Whether every cited path is on the list."""
    return F.size(F.array_except(cited, allowed)) == 0


# Where an article's body begins, in order of preference, and where it ends.
ARTICLE_STARTS = ('<div class="devsite-article-body', "devsite-article-body", "<article", "<main")
ARTICLE_ENDS = ("</devsite-content", "<devsite-page-rating", "</article")


def article_body(html: Column) -> Column:
    """What stands between the first start of an article (by preference) that has an end after it, and that end; empty if none has. Case is ignored."""
    low, out = F.lower(html), F.lit("")
    for start in reversed(ARTICLE_STARTS):
        at = F.locate(start, low)
        opened = F.when(at > 0, F.position(F.lit(">"), low, at))
        ends = [F.position(F.lit(e), low, opened) for e in ARTICLE_ENDS]
        end = F.coalesce(*(F.when(e > 0, e) for e in ends))
        out = F.when((opened > 0) & (end > opened), F.substr(html, opened + 1, end - opened - 1)).otherwise(out)
    return out


# Named entities that are decoded, ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Readable text: scripts, styles and comments go, block ends become line feeds, tags go, entities are decoded, space is squeezed."""
    t = html
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    # The ends that break a line.
    t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|tr|section|article)>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"[ \t\f\x0B\r]+", " ")
    return F.trim(F.regexp_replace(t, r"\n\s*\n\s*", "\n"))
