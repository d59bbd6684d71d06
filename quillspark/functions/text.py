"""Scalar text functions as native columns: normalisation, tokens, keywords, identifiers, table cells."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that search tokens leave out, without accents.
STOPWORDS = (
    "a ao aos as ate com como da das de dela delas dele deles do dos e ela elas ele eles em entre era eram essa essas esse esses esta estas este estes eu foi for foram ha isso isto ja lhe lhes mais mas me mesmo meu meus muito na nao nas nem no nos num numa o os ou para pela pelas pelo pelos por qual quais quando que quem se seja sejam sem ser seu seus so sao sua suas tambem tem temos ter uma um voce vos"
).split()
# Function words that keywords leave out, with accents.
KEYWORD_STOPWORDS = (
    "a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa essas esse esses esta estas este estes eu foi fomos for foram fosse fossem há isso isto já lhe lhes mais mas me mesmo meu meus minha minhas muito na não nas nem no nos nós nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual quando que quem se seja sejam sem seu seus só somos são sua suas também te tem temos tenho teu teus tu tua tuas um uma você vocês vos"
).split()
TOKEN = "[a-z0-9]+(?:[.,][0-9]+)*"
DECIMAL = r"\d+[.,]\d+"
NUMERIC_DENSITY = 0.03
SEPARATOR_ROW = r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*$"


@lru_cache(maxsize=4)
def folding(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for one-to-one folds of the Latin range and the marks to drop, and folds to several characters.

    Made by rule from the Unicode data for U+00A0..U+024F, U+1E00..U+1EFF, U+2070..U+209C, U+2150..U+218B and the
    combining marks.
    """
    one_from, one_to, several = [], [], []
    keep = (lambda c: not unicodedata.combining(c)) if form == "NFKD" else (lambda c: unicodedata.category(c) != "Mn")
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x209D), *range(0x2150, 0x218C), 0xFB00, 0xFB01, 0xFB02]:
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize(form, c) if keep(x))
        if folded != c:
            if len(folded) == 1:
                one_from.append(c)
                one_to.append(folded)
            else:
                several.append((c, folded))
    # translate() drops characters beyond the length of its target.
    marks = "".join(chr(c) for c in range(0x300, 0x370) if not keep(chr(c)))
    return "".join(one_from) + marks, "".join(one_to), tuple(several)


def fold_accents(text: Column, form: str = "NFKD") -> Column:
    source, target, several = folding(form)
    out = F.translate(text, source, target)
    # Rare characters that fold to more than one are replaced only where the text has any.
    replaced = out
    for c, folded in several:
        replaced = F.replace(replaced, F.lit(c), F.lit(folded))
    full = F.when(out.rlike("[" + "".join(c for c, _ in several) + "]"), replaced).otherwise(out) if several else out
    # Most texts have nothing to fold.
    return F.when(text.rlike(r"[^\x00-\x7F]"), full).otherwise(text)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def search_normal(text: Column) -> Column:
    """Accents folded by compatibility, lower case; null becomes empty."""
    return F.lower(fold_accents(F.coalesce(text, F.lit(""))))


def ascii_normal(text: Column) -> Column:
    """Accents folded canonically only: ordinals and superscripts stay."""
    return F.lower(fold_accents(F.coalesce(text, F.lit("")), "NFD"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def alias_normal(text: Column) -> Column:
    return collapse(search_normal(text))


def decimal_points(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")


def comparison_normal(text: Column) -> Column:
    return collapse(decimal_points(search_normal(text)))


def comparison_plain(text: Column) -> Column:
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Search tokens in order, repeats kept."""
    found = F.regexp_extract_all(decimal_points(search_normal(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ((F.length(t) > 1) | t.between("0", "9")) & ~t.isin(*STOPWORDS))


def keywords(text: Column) -> Column:
    """Lower-case words without outer punctuation; accents stay."""
    words = F.transform(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda w: F.regexp_replace(F.lower(w), r"^[.,;:!?()]+|[.,;:!?()]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*KEYWORD_STOPWORDS))


def simplified(text: Column) -> Column:
    """The three longest keywords (earlier ones first among equals) where there are two or more; else the text."""
    words = keywords(text)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    best = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["w"]), " ")
    return F.when(F.size(words) >= 2, best).otherwise(text)


def truncated(text: Column, limit: int) -> Column:
    """Cut at `limit` characters, back to the last space if that lies past the middle."""
    flat = collapse(F.coalesce(text, F.lit("")))
    head = F.substring(flat, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > limit // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.regexp_replace(cut, "[ ,;:.-]+$", ""))


def digit_density(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, "[^0-9]", "")) / n)


def has_numbers(text: Column) -> Column:
    return F.coalesce(text.rlike(DECIMAL), F.lit(False)) | (digit_density(text) >= NUMERIC_DENSITY)


def is_table_line(line: Column) -> Column:
    return F.startswith(F.trim(line), F.lit("|")) & (F.regexp_count(line, F.lit(r"\|")) >= 2)


def has_table(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.exists(lines, lambda x: x.rlike(SEPARATOR_ROW)) | (F.size(F.filter(lines, is_table_line)) >= 2)


def chunk_key(path: Column, chunk: Column) -> Column:
    return F.concat_ws("|", path, chunk.cast("string"))


def bare_number(number: Column) -> Column:
    """Digits without leading zeros; anything else as it is."""
    return F.when(number.rlike("^[0-9]+$"), F.regexp_replace(number, "^0+(?=.)", "")).otherwise(number)


def document_identifier(kind: Column, number: Column, year: Column) -> Column:
    """Type, number without leading zeros (zeros alone stay) and /year, as far as there are any."""
    number = F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), number, F.lit(""))), F.lit(""))
    year = F.nullif(F.trim(F.coalesce(year, F.lit(""))), F.lit(""))
    return F.concat(F.concat_ws(" ", F.nullif(F.trim(F.coalesce(kind, F.lit(""))), F.lit("")), number), F.coalesce(F.concat(F.lit("/"), year), F.lit("")))


def source_id(kind: Column, number: Column, year: Column) -> Column:
    known = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("N/A"))
    return F.concat(known(kind), F.lit(" "), known(number), F.lit("/"), known(year))


def standard_key(path: Column, kind: Column, number: Column, year: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(path), F.lit("")), F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (kind, number, year))))


def padded(number: Column, width: int = 8) -> Column:
    """Zero-filled on the left, never cut."""
    return F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))


def regulatory_id(kind: Column, number: Column, year: Column) -> Column:
    return F.concat_ws("-", kind, padded(number.cast("string")), year.cast("string"))


def without_front_matter(text: Column) -> Column:
    """Drops a leading block between two --- marks."""
    end = F.locate("---", text, 4)
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), F.regexp_replace(F.substring(text, end + 3, F.length(text)), r"^\n+", "")).otherwise(text)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values), F.lit(""))


def filter_text(value: Column, every: str = "Todos") -> Column:
    """The trimmed value; null where it is empty or asks for all."""
    value = F.trim(value.cast("string"))
    return F.when((value != "") & (value != every), value)


def safe_filename(name: Column, fallback: str = "document") -> Column:
    base = F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), "_+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def table_cell(value: Column) -> Column:
    """Escapes pipes and line ends; null is empty."""
    return F.trim(F.translate(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n", "  "))


def markdown_table(rows: Column) -> Column:
    """rows: array of arrays of cells; the first is the header. Empty where no cell has text."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: table_cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line))
    filled = F.exists(rows, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""))
    return F.when((F.size(rows) > 0) & filled, F.array_join(lines, "\n")).otherwise(F.lit(""))


def image_links(text: Column) -> Column:
    """(alt, url, key) of the remote images of a markdown text; the key is that of the OCR cache."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"!\[[^\]]*\]\((https?://[^)\s]+)[^)]*\)"), F.lit(1))
    return F.transform(found, lambda u: F.struct(u.alias("url"), F.left(F.sha2(F.encode(u, "UTF-8"), 256), F.lit(16)).alias("key")))
