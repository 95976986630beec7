"""Template residue, filler text and error pages that stand in place of a page's own words.

A text is read as printed and, where lines hold columns side by side, once more column by column. Letters that scanners
confuse are folded to one each, words broken at line ends joined. Placeholders are found by one grammar per delimiter, judged by the words around them; messages by
the grammar in ``messages``; filler by repetition and by the shape of its words. All of it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.messages import CONFUSED, FOLDED_TO, PAIRS, anchor_pattern, filler_pattern, fold, known_latin_pattern, made_up_latin_patterns, rules, squeezed

#: Names that templates give their fields, where a delimiter alone (French quotation marks) proves nothing.
FIELDS = "author byline headline title subtitle date lead editor section caption newspaper place publisher name body content text summary keywords".split()
#: What editors put between braces.
EDITORIAL = "sic torn illegible missing unreadable blank unleserlich unlesbar fehlt illisible déchiré manque onleesbaar gescheurd ontbreekt".split()
#: Before a placeholder these say that it is talked about, not left over.
TAUGHT = ("for example", "for instance", "such as", "syntax", "zum beispiel", "z. b.", "par exemple", "p. ex.", "bijvoorbeeld", "bijv.", "por ejemplo", "per esempio", "por exemplo")
#: Of a page's placeholders so many times as many must be left as not introduced; fewer belong to the same lesson.
LESSON = 4

#: Letters below which a text is compared with filler as a whole; longer filler has the rows of words that are looked for anyway.
SHORT = 300
#: What every placeholder begins with, or the end of one whose beginning is lost.
DELIMITERS = r"[\[{<%$#@«_(&}]"
#: Columns whose lines may alternate in a text without boxes.
INTERLEAVED = 8


def folded(text: Column) -> Column:
    for a, b in PAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, CONFUSED, FOLDED_TO)


def placeholder_pattern() -> str:
    """Grammars by delimiter, over folded text with single blanks."""
    name = r"[\p{L}_][\p{L}\p{N}_.,-]*"
    f = fold
    inside = r"[^\[\]{}<>()]"
    fields = "|".join(sorted({f(w) for w in FIELDS}))
    editorial = "|".join(sorted({f(w) for w in EDITORIAL} | {"sio", "sii"}))
    # delimiters that nothing else uses count even where an advert or a column has swallowed their end
    grammars = [
        r"\{\{ ?#?[\p{L}_]",
        r"\{% ?\p{L}",
        r"<%=? ?[\p{L}_]",
        r"<\?(?:=|php)? ?\$?[\p{L}_]",
        rf"[$#]\{{ ?{name} ?\}}",
        rf"%% ?{name} ?%%",
        rf"%\({name}\)[sdi]?",
        rf"%{name}%",
        rf"@@ ?{name} ?@@",
        rf"\[\[ ?{name}",
        rf"(?<!_)__[\p{{L}}][\p{{L}}\p{{N}}.,]*(?:_[\p{{L}}\p{{N}}.,]+)*__(?!_)",
        rf"\${name}\$",
        rf"\{{(?!(?:{editorial})\}}){name}\}}",
        r"\}\}",
        rf"« ?(?:{fields}|\p{{L}}+[_.][\p{{L}}\p{{N}}]+) ?»",
        rf"<{inside}{{1,40}} {f('goes')} ?{f('here')}>",
        rf"&{f('lt')}; ?/?{name} ?/?&{f('gt')};",
        r"<< ?[\p{L}_]",
        rf"\[{f('your')} {f('text')}\b",
        rf"\[{f('your')} {inside}{{1,40}}\]",
        rf"\[(?:{f('insert')}|{f('insérer')}|{f('einfügen')}|{f('invullen')}) {name}",
        rf"\[{inside}{{1,40}} (?:{f('here')}|{f('ici')}|{f('hier')} ?{f('einfügen')}|{f('hier')} ?{f('invullen')}|{f('eintragen')}|{f('à compléter')})\]",
        rf"\[{name}: ?{f('to')}\b",
        rf"\[tk\b",
        rf"\[(?:{f('platzhalter')}|{f('placeholder')})\b",
        rf"\((?:{f('enter')}|{f('insert')}) {name}\)",
    ]
    return rf"(?={DELIMITERS})(?:" + "|".join(grammars) + ")"


def introduced_pattern() -> str:
    """Placeholders that words such as "for example" introduce: the first within 40 characters of them, each further one within 60 of the one before, all in one sentence."""
    taught = "|".join(fold(w).replace(".", r"\.") for w in TAUGHT)
    whole = rf"{placeholder_pattern()}(?:(?:[^{{}}\[\]<>%$«»@().]|\.(?=\S)){{0,60}}(?:\}}\}}?|%\}}|%>|%%|@@|\]\]?|>>?|»|\$|\)s?))?"
    return rf"(?:{taught})[^.]{{0,40}}?{whole}(?:[^.]{{0,60}}?{whole})*"


def let(value: Column, f) -> Column:
    """f(value), computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Further columns, each worked out once for a row: the optimiser would otherwise write their expressions out wherever filters and later columns name them."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def in_columns(lines: Column, column) -> Column:
    """The lines put together column by column; column(i) is the column of line i. Null if that is their order anyway."""
    placed = F.transform(lines, lambda x, i: F.struct(column(i).alias("column"), i.alias("i"), x.alias("line")))
    ordered = let(placed, lambda p: let(F.sort_array(p), lambda s: F.when(s != p, F.array_join(F.transform(s, lambda x: x["line"]), "\n"))))
    return ordered


def boxed(lines: Column, boxes: Column) -> Column:
    """The lines by the column that their box lies in. A column starts where left edges leave a gap of more than half the usual width of a line."""
    gap = F.get(F.array_sort(F.transform(boxes, lambda b: b["w"])), F.floor(F.size(boxes) / 2).cast("int")) / 2
    edges = F.array_sort(F.array_distinct(F.transform(boxes, lambda b: b["x"])))
    starts = let(F.struct(gap.alias("gap"), edges.alias("edges")), lambda g: F.filter(g["edges"], lambda x, i: (i == 0) | (x - F.get(g["edges"], i - 1) > g["gap"])))
    return let(starts, lambda s: F.when(F.size(s) > 1, in_columns(lines, lambda i: F.size(F.filter(s, lambda x: x <= F.get(boxes, i)["x"])))))


def goes_back(boxes: Column) -> Column:
    """Whether a line can lie in a column before that of the line above it: its left edge must lie further left by half a line's width, however narrow."""
    back = F.array_max(F.transform(boxes, lambda b, i: F.get(boxes, i - 1)["x"] - b["x"]))
    return F.coalesce(back > F.array_min(F.transform(boxes, lambda b: b["w"])) / 2, F.lit(True))


def regrouped(text: Column, boxes: Column | None) -> Column:
    """The text column by column where its columns alternate line by line; null where they don't. Without a box for every line, every n-th line is read, for each n up to INTERLEAVED."""
    lines = F.split(text, "\n")
    strides = lambda x: F.concat_ws("\n\n", *[F.when(F.size(x) > n, in_columns(x, lambda i, n=n: i % n)) for n in range(2, INTERLEAVED + 1)])
    if boxes is None:
        return let(lines, strides)
    return let(lines, lambda x: F.when(F.size(x) == F.size(boxes), F.when(goes_back(boxes), boxed(x, boxes))).otherwise(strides(x)))


def side_by_side(text: Column) -> Column:
    """Every column of the lines that hold several, and the last pieces of all lines; where lines begin with blanks, also with an empty piece for those."""

    def pieces(trimmed) -> Column:
        return F.transform(F.split(text, r"\r?\n"), lambda x: F.split(trimmed(x), " {2,}"))

    def columns(p: Column) -> Column:
        every = F.sequence(F.lit(0), F.array_max(F.transform(p, lambda q: F.size(q))) - 1)
        return F.array_join(F.transform(every, lambda at: F.array_join(F.transform(p, lambda q: F.coalesce(F.get(q, at), F.lit(""))), "\n")), "\n\n")

    last = F.array_join(F.transform(pieces(F.trim), lambda q: F.element_at(q, -1)), "\n")
    return F.concat_ws("\n\n", let(pieces(F.trim), columns), F.when(text.rlike(r"(?:^|\n) {2,}\S"), let(pieces(F.rtrim), columns)), last)


def readings(text: Column, boxes: Column | None = None) -> Column:
    """The text as printed, then column by column where they alternate line by line, then, where lines hold several columns, each of them and the last ones; in lower case, broken words joined, single blanks."""
    side = F.when(text.rlike(r"\S {2,}\S"), side_by_side(text))
    whole = F.concat_ws("\n\n", text, regrouped(text, boxes), side)
    return F.lower(F.regexp_replace(whole, "[-\\u00AD\\u2010=\\u00AC][ \\t]*\\r?\\n\\s*", ""))


def left_over(read: Column) -> Column:
    """The first placeholder that nothing introduces; null if there is none or if the page teaches."""
    found = placeholder_pattern()
    coded = rf"```[^`]*```|`[^`\n]{{1,200}}`|<{fold('code')}>[^<]*</{fold('code')}>|<{fold('pre')}>[^<]*</{fold('pre')}>"
    plain = F.regexp_replace(F.regexp_replace(folded(read), r"[\s ]+", " "), coded, " ")
    every = lambda text: F.regexp_extract_all(text, F.lit(f"({found})"), F.lit(1))
    judged = let(plain, lambda p: F.when(p.rlike(found), F.struct(F.size(every(p)).alias("n"), every(F.regexp_replace(p, introduced_pattern(), " ")).alias("left"))))
    return let(judged, lambda j: F.when(F.size(j["left"]) * LESSON > j["n"], F.get(j["left"], F.lit(0))))


def residue(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", box_column: str = "line_box", keep: list[str] | None = None) -> DataFrame:
    """id, the columns in ``keep``, placeholder, message: what gave a text away, null where nothing did; one row per row of ``documents``.

    Text between code fences, backticks or <code> tags and placeholders that are introduced as examples (see introduced_pattern) are no residue, each judged by its own surroundings; where at least LESSON - 1
    out of LESSON placeholders of a page are introduced, the page teaches and the rest is no residue either. Lines of columns that alternate are put together by ``box_column`` (x and w, one box for each line split at "\\n") if the table has it.
    Null and empty texts have nothing. Texts are searched whole; no shuffle. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    kept = [id_column, *(keep or [])]
    df = once(documents.select(*kept, text.alias("_text"), *([F.col(box_column).alias("_boxes")] if box_column in documents.columns else [])), _read=readings(F.col("_text"), F.col("_boxes") if box_column in documents.columns else None))
    df = once(df.select(*kept, "_read"), _squeezed=squeezed(F.col("_read")))
    none = lambda c: F.when(c != "", c)
    # what follows is costly only where a delimiter or an anchor stands
    placeholder = F.when(F.col("_read").rlike(DELIMITERS), left_over(F.col("_read")))
    said = F.coalesce(*(F.when(F.col("_squeezed").rlike(anchor_pattern([a])), none(F.regexp_extract("_squeezed", p, 0))) for a, p in rules()), none(F.regexp_extract(folded(F.col("_read")), filler_pattern(), 0)), none(F.regexp_extract("_read", known_latin_pattern(), 0)))
    row, alone = made_up_latin_patterns()
    made_up = F.coalesce(none(F.regexp_extract("_read", row, 0)), F.when(F.length("_squeezed") < SHORT, none(F.regexp_extract("_read", alone, 0))))
    message = F.coalesce(F.when(F.col("_squeezed").rlike(anchor_pattern()), said), made_up)
    df = once(df, _found=F.struct(placeholder.alias("placeholder"), message.alias("message")))
    return df.select(*kept, "_found.placeholder", "_found.message")
