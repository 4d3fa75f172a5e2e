"""Cleaning of landed web pages with JVM-side regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.text import SPACE, collapse_ws, strip_space

# Words that mark a parenthesised stage direction.
STAGE_MARKERS = (
    "Oklaski",
    "Głos z sali",
    "Wesołość",
    "Dzwonek",
    "Śmiech",
    "ha, ha",
    "Poseł",
    "Posłanka",
    "Marszałek",
    "Sekretarz",
)

# How a procedural line starts, or what it contains.
PROCEDURAL_STARTS = (
    "marszał",
    "wicemarszał",
    "sekretar",
    "przewodnicz",
    "ogłaszam",
    "otwieram",
    "zamykam",
    "wznawiam",
    "poseł",
    "posłanka",
)
PROCEDURAL_PHRASES = (
    "w imieniu klubu",
    "w imieniu koła",
    "klubu parlamentarnego",
    "klub parlamentarny",
    "parlamentarnej grupy",
    "koła parlamentarnego",
    "udzielam głosu",
    "głos ma",
    "głos zabierze",
    "dopomóż bóg",
    "porządku dzien",
)
# Two rules that the observed behaviour never applies; see ``strict_rules``.
STRICT_STARTS = (r"(?:panie|pan)\s+po?s[łe]ł", r"\d+\.\s*(?:posiedzenie|punkt)")

# Phrases of a verification page.
BLOCKED_MARKERS = (
    "Please enable JavaScript",
    "What code is in the image",
    "testing whether you are a human visitor",
    "Audio is not supported in your browser",
    "Press & Hold",
    "captcha",
)

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _any_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, decoded once (``&amp;lt;`` gives ``&lt;``)."""
    listed = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
    names = F.str_to_map(
        F.lit("\x01".join(f"{name}\x02{char}" for name, char in listed.items())),
        F.lit("\x01"),
        F.lit("\x02"),
    )

    def by_code(ref: Column) -> Column:
        digits = F.when(
            ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)
        ).otherwise(F.substr(ref, F.lit(2)))
        code = digits.try_cast("int")
        # A code point becomes a character by way of its four bytes.
        good = code.between(1, 55295) | code.between(57344, 1114111)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decode(piece: Column, i: Column) -> Column:
        reference = F.regexp_extract(
            piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1
        )
        decoded = bind(
            reference,
            lambda ref: F.concat(
                F.when(ref.startswith("#"), by_code(ref)).otherwise(F.try_element_at(names, ref)),
                F.substr(piece, F.length(ref) + 2),
            ),
        )
        return F.when(i == 0, piece).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), piece)))

    # The first piece has no "&" before it and passes unchanged.
    return bind(
        text,
        lambda x: F.when(
            F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "&"), decode), "")
        ).otherwise(x),
    )


def html_text(html: Column) -> Column:
    """Text nodes joined by newline; scripts, styles, comments and tags dropped."""
    bare = F.regexp_replace(
        html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", ""
    )
    return decode_entities(F.regexp_replace(bare, "<[!/?a-zA-Z][^>]*>", "\n"))


def strip_stage(text: Column, markers=STAGE_MARKERS) -> Column:
    return F.regexp_replace(text, rf"(?iu)\([^)]*{_any_of(markers)}[^)]*\)", " ")


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]]+\]", " ")


def procedural_line(
    line: Column,
    starts=PROCEDURAL_STARTS,
    phrases=PROCEDURAL_PHRASES,
    strict_rules: bool = False,
) -> Column:
    if strict_rules:
        starts = (*starts, *STRICT_STARTS)
    return F.lower(line).rlike(f"^{_any_of(starts)}|{_any_of(phrases)}")


def kept_lines(text: Column, **rules) -> Column:
    """Trimmed lines that are neither blank nor procedural."""
    lines = F.transform(F.split(text, _LINE_END), strip_space)
    return F.filter(lines, lambda line: (line != "") & ~procedural_line(line, **rules))


def clean_text(html: Column, strict_rules: bool = False) -> Column:
    """A page down to the spoken or written words, on one line."""
    text = strip_brackets(strip_stage(html_text(html)))
    return collapse_ws(F.array_join(kept_lines(text, strict_rules=strict_rules), " "))


def is_blocked(html: Column, markers=BLOCKED_MARKERS) -> Column:
    low = F.lower(html)
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(low, F.lit(marker.lower()))
    return hit


# Fixed values of the language: elements without an end tag; start tags that end open elements
# (each up to the innermost of the third list); end tags look no further out than a table.
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()
_CELLS, _SECTIONS = ["td", "th"], ["tbody", "thead", "tfoot"]
_BLOCKS = (
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul"
).split()
IMPLIED_ENDS = (
    (_CELLS, _CELLS, ["table"]),
    (["tr"], ["tr"], ["table"]),
    (_SECTIONS, [*_SECTIONS, "caption", "colgroup"], ["table"]),
    (["li"], ["li"], ["ul", "ol", "table"]),
    (["dt", "dd"], ["dt", "dd"], ["dl", "table"]),
    (["option", "optgroup"], ["option"], ["select", "table"]),
    (_BLOCKS, ["p"], ["td", "th", "table", "button"]),
)
_TEXT, _OPEN, _CLOSE, _END = 0, 1, 2, 3
# An open element: its tag, the token it begins at, its text as far as an equal label needs it,
# the end of its text, whether it holds the label, its child elements so far, where its
# second one begins and ends, whether one held the label, and what a label among them waits for.
_NODE = "struct<tag:string,b:int,eq:string,tail:string,has:boolean,kids:int,sb:int,se:int,hit:boolean,wants:boolean,td:boolean,th:boolean>"
_SPAN = "struct<b:int,e:int>"
_SPANS = ("td", "th", "beside", "row", "h1", "h2", "title")


def _tokens(html: Column) -> Column:
    """array<struct<kind, tag, text>> of a page without scripts, styles and comments, and an end mark."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    raw = F.regexp_extract_all(bare, F.lit(r"<[!/?a-zA-Z][^>]*>|[^<]+|<"), F.lit(0))

    def token(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, "^</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>$", 1))
        kind = F.when(tag == "", F.when(piece.rlike("^<[!/?a-zA-Z]"), None).otherwise(_TEXT)).when(piece.startswith("</"), _CLOSE).otherwise(_OPEN)
        return F.struct(kind.alias("kind"), tag.alias("tag"), F.when(tag == "", decode_entities(piece)).otherwise("").alias("text"))

    end = F.struct(F.lit(_END).alias("kind"), F.lit("").alias("tag"), F.lit("").alias("text"))
    return F.concat(F.filter(F.transform(raw, token), lambda t: t["kind"].isNotNull()), F.array(end))


def _last(stack: Column, tags: list[str]) -> Column:
    """Place from 1 of the innermost open element of these tags, 0 if none is open."""
    return F.coalesce(F.array_max(F.transform(stack, lambda e, i: F.when(e["tag"].isin(tags), i + 1))), F.lit(0))


def _kept(stack: Column, kind: Column, tag: Column) -> Column:
    """How many open elements stay open when a tag comes."""
    size = F.size(stack)
    after_start = size
    for starts, ended, within in IMPLIED_ENDS:
        found = _last(stack, ended)
        after_start = F.when(tag.isin(starts), F.when(found > _last(stack, within), found - 1).otherwise(size)).otherwise(after_start)
    own = F.coalesce(F.array_max(F.transform(stack, lambda e, i: F.when(e["tag"] == tag, i + 1))), F.lit(0))
    table = F.when(tag == "table", 0).otherwise(_last(stack, ["table"]))
    return F.when(kind == _OPEN, after_start).when(kind == _END, 1).otherwise(F.when(own > table, own - 1).otherwise(size))


def _with(record: Column, /, **changes: Column) -> Column:
    for name, value in changes.items():
        record = record.withField(name, value)
    return record


def _node(tag: Column, at: Column) -> Column:
    no, none = F.lit(False), F.lit(None)
    values = {"tag": tag, "b": at, "eq": F.lit(""), "tail": F.lit(""), "has": no, "kids": F.lit(0), "sb": none, "se": none, "hit": no, "wants": no, "td": no, "th": no}
    return F.struct(*(v.alias(n) for n, v in values.items())).cast(_NODE)


def label_spans(tokens: Column, label: str | None = None) -> Column:
    """struct of the spans of tokens (b exclusive to e) that hold a label's values and the headings.

    td, th: the next td beside the first header cell or cell with just the label; beside: what
    follows the first element with just the label; row: the second child of the first row
    one of whose children mentions it; h1, h2, title: the first such element. One pass over the
    tokens with a stack of open elements; tags left open end as a browser ends them.
    """
    wanted, size = label or "\x00", len(label or "")
    blank = F.lit(None).cast(_SPAN)
    state = F.struct(F.lit(None).cast("int").alias("at"), F.array(_node(F.lit("#page"), F.lit(-1))).alias("stack"), *(blank.alias(n) for n in _SPANS))

    def on_text(s: Column, text: Column) -> Column:
        def joined(held: Column, more: Column) -> Column:
            return F.concat(held, F.when((held == "") | held.endswith(" "), F.ltrim(more)).otherwise(more))

        def grown(e: Column, more: Column) -> Column:
            tail = joined(e["tail"], more)
            return _with(e, eq=F.substring(joined(e["eq"], more), 1, size + 2), has=e["has"] | F.contains(tail, F.lit(wanted)), tail=F.substring(tail, -size - 1, size + 1))

        return bind(F.regexp_replace(text, f"{SPACE}+", " "), lambda more: _with(s, stack=F.transform(s["stack"], lambda e: grown(e, more)))) if label else s

    def closed(s: Column, kept: Column) -> Column:
        """The elements beyond the first ``kept`` end here."""
        at = s["at"]
        gone = F.slice(s["stack"], kept + 1, F.size(s["stack"]) - kept)

        def with_gone(gone: Column) -> Column:
            first = F.get(gone, 0)
            ended = {
                n: F.when(s[n]["e"].isNull() & F.exists(gone, lambda e: e["b"] == s[n]["b"]), s[n].withField("e", at)).otherwise(s[n])
                for n in _SPANS
                if n != "row"
            }

            def row_value(e: Column, i: Column) -> Column:
                child = F.get(gone, i + 1)
                held = e["hit"] | F.coalesce(child["has"], F.lit(False))
                return F.when((e["tag"] == "tr") & held & e["sb"].isNotNull(), F.struct(e["sb"].alias("b"), F.coalesce(e["se"], at).alias("e")))

            # the first of all in the page is that which begins first
            rows = F.array_append(F.transform(gone, row_value), s["row"])
            labelled = F.rtrim(first["eq"]) == wanted
            top = lambda e: _with(
                e,
                hit=e["hit"] | first["has"], se=F.when(e["sb"] == first["b"], at).otherwise(e["se"]),
                wants=labelled, **{n: e[n] | (labelled & (first["tag"] == n)) for n in _CELLS},
            )
            stack = F.transform(F.slice(s["stack"], 1, kept), lambda e, i: F.when(i + 1 == kept, top(e)).otherwise(e))
            return F.when(F.size(gone) > 0, _with(s, stack=stack, row=F.array_min(F.array_compact(rows)), **ended)).otherwise(s)

        return bind(gone, with_gone)

    def opened(s: Column, tag: Column) -> Column:
        at, parent = s["at"], F.try_element_at(s["stack"], F.lit(-1))
        second = (parent["kids"] == 1) & (parent["tag"] == "tr")
        void = tag.isin(VOID_TAGS)
        span = F.struct(at.alias("b"), F.when(void, at).alias("e"))
        begun = {n: F.when(s[n].isNull() & (tag == n), span).otherwise(s[n]) for n in ("h1", "h2", "title")}
        begun["beside"] = F.when(s["beside"].isNull() & parent["wants"], span).otherwise(s["beside"])
        for n in _CELLS:
            begun[n] = F.when(s[n].isNull() & parent[n] & (tag == "td"), span).otherwise(s[n])
        grown = lambda e: _with(
            e, kids=e["kids"] + 1, sb=F.when(second, at).otherwise(e["sb"]), se=F.when(second & void, at).otherwise(e["se"]), wants=F.lit(False),
            **{n: e[n] & (tag != "td") for n in _CELLS},
        )
        stack = F.transform(s["stack"], lambda e, i: F.when(i + 1 == F.size(s["stack"]), grown(e)).otherwise(e))
        return _with(s, stack=F.when(void, stack).otherwise(F.array_append(stack, _node(tag, at))), **begun)

    def step(s: Column, token: Column) -> Column:
        def moved(s: Column) -> Column:
            after = bind(_kept(s["stack"], token["kind"], token["tag"]), lambda kept: closed(s, kept))
            return bind(after, lambda s: F.when(token["kind"] == _OPEN, opened(s, token["tag"])).otherwise(s))

        return bind(_with(s, at=F.coalesce(s["at"] + 1, F.lit(0))), lambda s: F.when(token["kind"] == _TEXT, on_text(s, token["text"])).otherwise(moved(s)))

    return F.aggregate(tokens, state, step)


def _span_text(tokens: Column, span: Column) -> Column:
    """Collapsed text between two tokens, null if there is none."""
    inside = F.slice(tokens, span["b"] + 2, F.greatest(span["e"] - span["b"] - 1, F.lit(0)))
    words = F.array_join(F.transform(inside, lambda t: F.when(t["kind"] == _TEXT, t["text"]).otherwise(" ")), "")
    return F.when(span.isNotNull(), F.nullif(collapse_ws(words), F.lit("")))


def page_heading(html: Column, max_len: int = 80, banned: str = "Sejm") -> Column:
    """First h1, else first h2, if short and free of the site's own name; else the title."""

    def guarded(text: Column) -> Column:
        return bind(
            text,
            lambda x: F.when((F.length(x) <= max_len) & ~F.contains(x, F.lit(banned)), x),
        )

    def pick(tokens: Column) -> Column:
        return bind(
            label_spans(tokens),
            lambda s: F.coalesce(guarded(_span_text(tokens, s["h1"])), guarded(_span_text(tokens, s["h2"])), _span_text(tokens, s["title"])),
        )

    return bind(_tokens(html), pick)


def label_value(html: Column, label: str) -> Column:
    """Text beside a label: table cell, any following sibling, then second cell of its row.

    Of each rule the first match in the page counts; if it is empty, the next rule is tried.
    The label must be the whole text of its element, for the last rule a part of it.
    """
    label = " ".join(label.split())

    def pick(tokens: Column) -> Column:
        return bind(label_spans(tokens, label), lambda s: F.coalesce(*(_span_text(tokens, s[n]) for n in ("td", "th", "beside", "row"))))

    return bind(_tokens(html), pick)


def profile(
    pages: DataFrame,
    num: str,
    tenure_label: str = "Staż parlamentarny:",
    school_label: str = "Ukończona szkoła:",
    **heading,
) -> DataFrame:
    """Profile fields of each page; a page that yields none carries an error instead."""
    html = F.col("html")
    fields = pages.select(
        F.col(num).alias("mp_num"),
        "url",
        page_heading(html, **heading).alias("name"),
        label_value(html, tenure_label).alias("staz_parlamentarny"),
        label_value(html, school_label).alias("ukonczona_szkola"),
    )
    found = F.coalesce("name", "staz_parlamentarny", "ukonczona_szkola")
    return fields.withColumn("error", F.when(found.isNull(), "no fields"))
