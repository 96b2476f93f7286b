"""Operator 6, quality rules: line-first cleaning with DataFrame expressions only.

Every line is judged by itself, relative to its own length: lines of symbols, of punctuation, in capitals, long ones without any
punctuation, navigation, links, and boilerplate (phrases and forms) fail. Failed lines are removed; a document that loses more than `max_lost` of its
characters is rejected. Document-wide figures (words, symbols, repeated lines and passages) come with the verdict.

Capitals and missing marks tell something only of scripts with letter cases, so texts of other scripts are not judged by them; and missing marks
only within a text that has marks elsewhere, so verse, transcripts and lists of words stay. Rows of tables in text form (two or more in a row that begin and end
with a bar) are no navigation.

Defined results: a null text has no words (all figures 0) and fails; an empty text likewise. Repeated rows are judged
alike, each by itself. Nothing depends on other rows, so there are no ties and no shuffles. Columns other than
the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import WORD_BREAK, fresh, read

#: Fixed values of the base figures: characters counted as symbols, words in a window.
SYMBOLS = r"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Line rules. A line fails if over this share of its characters are symbols.
MAX_LINE_SYMBOLS = 0.1
#: Navigation: at least so many separators, and at most so many words to each.
MIN_SEPARATORS, WORDS_A_SEPARATOR = 3, 5
#: Capitals: no small letter, and so many capitals at least.
MIN_CAPITALS = 20
#: Punctuation: over this share of the characters that are not white space, and so many marks at least; or no mark at all in a line of
#: at least so many words that has capitals or small letters, in a text that has a mark for every so many words.
MAX_PUNCTUATION, MIN_MARKS = 0.4, 4
MIN_UNMARKED_WORDS = 20
#: No word: so many characters at least without a letter or digit.
MIN_WORDLESS = 20
#: Links: over this share of the characters.
MAX_LINKS = 0.5
#: Boilerplate: a phrase fails a line of at most so many words, or one of which it is over this share; longer lines are prose.
PHRASE_WORDS, PHRASE_SHARE, PHRASE_LINE = 12, 0.2, 250
#: Phrases of boilerplate in English, French, German and Spanish.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "accept cookies",
    "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "read more", "share on facebook",
    "share on twitter", "skip to content", "back to top", "powered by", "licensed under", "spdx-license-identifier", "lorem ipsum",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "lire la suite", "en savoir plus",
    "cliquez ici", "accepter les cookies", "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken",
    "mehr erfahren", "cookies akzeptieren", "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal",
    "haga clic aquí", "leer más", "aceptar cookies",
)
#: A document goes if its failed lines hold over this share of its characters.
MAX_LOST = 0.5


def _let(value: str, name: str, body: str) -> str:
    """SQL in which `name` stands for `value` within `body`, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _rx(pattern: str) -> str:
    """A pattern as it stands in a literal of Spark's SQL."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Patterns that Java and RE2 read alike.
_SYMBOL, _SEPARATOR, _LINK = r"#*$%&|<>{}~^=_\\", "|»›·•", r"(?:https?://|www[.])[^ \t]+"
_BLANKS, _IN_WORD = r"[ \t\x0B\f\r]+", r"[\p{L}\p{N}]"  # a pattern of whole words would go back and forth in long runs without a letter
_TABLE_ROW = r"^[ \t]*[|].*[|][ \t\r]*"
#: Forms of boilerplate in a short line: claims of copyright with a year, numbers of pages.
_FORM = r"[ \t](?:copyright|©|[(]c[)])[^0-9]{0,40}(?:19|20)[0-9][0-9]|^[ \t]*(?:page|seite|página|pagina)[ \t]+[0-9]+[ \t]*(?:of|sur|von|de|/)[ \t]*[0-9]+[ \t\r]*$"
_FORM_HINT = r"copyright|©|[(]c[)]|(?:page|seite|página|pagina)[ \t]+[0-9]"
_PHRASE = "[ \t](?:" + "|".join(p.replace(" ", "[ \t]+") for p in BOILERPLATE) + ")"


def _gates(text: str) -> str:
    """Of a whole text, once: whether any of its lines can fail by the rule, so that most lines are spared most rules."""
    has = {"symbols": f"{text} rlike '{_rx('[' + _SYMBOL + ']')}'", "separators": f"{text} rlike '[{_SEPARATOR}]'", "links": f"contains({text}, '://') or contains({text}, 'www.')", "phrases": f"concat(' ', lower({text})) rlike '{_rx(_PHRASE.replace('[ ', '[ ' + chr(92) + 'n', 1))}'"}
    has |= {"forms": f"lower({text}) rlike '{_rx(_FORM_HINT)}'", "tables": f"{text} rlike '{_rx('(?m)' + _TABLE_ROW + chr(92) + 'n' + _TABLE_ROW.removeprefix('^') + '$')}'", "marked": f"{MIN_UNMARKED_WORDS} * length(regexp_replace({text}, '{_rx('[^' + chr(92) + 'p{P}]+')}', '')) >= size(words)"}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in has.items()) + ")"


def _line_fails(line: str, gate: str) -> str:
    without = lambda pattern, of=line: f"length(regexp_replace({of}, '{_rx(pattern)}', ''))"
    has = lambda pattern: f"{line} rlike '{_rx(pattern)}'"
    words = f"size(filter(split({line}, '{_rx(_BLANKS)}'), w -> w rlike '{_rx(_IN_WORD)}'))"
    table = f"({gate}.tables and {has(_TABLE_ROW + '$')})"
    # an opening quote that stands before a space answers a closing one that does; other closing quotes touch a word
    split = f"split({line}, '[ \\t\\r]+')"
    alone = f"greatest(0, size(filter({split}, w -> w in ('»', '›', '·'))) - size(filter({split}, w -> w in ('«', '‹'))))"
    count = f"({without('[^|•]+')} + {alone})"
    lowered = f"concat(' ', lower({line}))"
    rules = [
        f"({gate}.symbols and {without('[^' + _SYMBOL + ']+')} - if({table}, {without('[^|]+')}, 0) > {MAX_LINE_SYMBOLS} * length({line}))",
        f"({gate}.separators and {has('[' + _SEPARATOR + ']')} and not {table} and {_let(count, 'c', f'c >= {MIN_SEPARATORS} and {words} <= {WORDS_A_SEPARATOR} * c')})",
        f"(not {has(chr(92) + 'p{Ll}')} and {without('[^' + chr(92) + 'p{Lu}]+')} >= {MIN_CAPITALS})",
        _let(without("[^" + chr(92) + "p{P}]+"), "c", f"if(c = 0, {gate}.marked and {words} >= {MIN_UNMARKED_WORDS} and {has(chr(92) + 'p{Lu}|' + chr(92) + 'p{Ll}')}, c >= {MIN_MARKS} and not {table} and c > {MAX_PUNCTUATION} * {without('[ ' + chr(92) + 't' + chr(92) + 'r]+')})"),
        f"(length({line}) >= {MIN_WORDLESS} and not {table} and not {has(_IN_WORD)})",
        f"({gate}.links and {without(_LINK)} < {1 - MAX_LINKS} * length({line}))",
        f"({gate}.phrases and length({line}) <= {PHRASE_LINE} and {lowered} rlike '{_rx(_PHRASE)}' and ({words} <= {PHRASE_WORDS} or length({lowered}) - {without(_PHRASE, lowered)} > {PHRASE_SHARE} * length({lowered})))",
        f"({gate}.forms and length({line}) <= {PHRASE_LINE} and {lowered} rlike '{_rx(_FORM)}' and {words} <= {PHRASE_WORDS})",
    ]
    return "(" + " or ".join(rules) + ")"


def _repeated_words() -> str:
    """Words in windows of `words` that occur twice or more: windows are hashed, equal hashes found by sorting, and the
    union of their intervals summed. Texts without a repeat stop after the distinct count."""
    hashes = f"if(size(words) >= {WINDOW}, transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))), cast(array() as array<bigint>))"
    ordered = "array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
    places = "sort_array(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) or coalesce(get(s, j + 1).x = e.x, false)), e -> e.i))"
    summed = f"aggregate(transform(p, (v, j) -> least({WINDOW}, coalesce(get(p, j + 1) - v, {WINDOW}))), 0L, (a, v) -> a + v)"
    count = _let(ordered, "s", _let(places, "p", summed))
    return _let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0L, {count})")


def measures(text: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS, with_text: bool = False) -> Column:
    """One struct of figures and verdict for a text column, given by name: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lost_share; with_text: and the text without its failed lines (null as an empty text)."""
    if not isinstance(text, str):
        raise TypeError("give the text column by name")
    has_word = lambda line: rf"{line} rlike '[^ \\t\\n\\x0B\\f\\r]'"
    body = f"""named_struct(
        'n_words', cast(size(words) as bigint),
        'word_chars', cast(length(array_join(words, '')) as bigint),
        'n_symbols', cast(length(regexp_replace(t, '[^{SYMBOLS}]+', '')) as bigint),
        'n_dup_lines', cast(size(lines) - size(array_distinct(lines)) as bigint),
        'n_repeat_words', {_repeated_words()},
        'chars', cast(length(array_join(lines, '')) as bigint),
        'left', cast(length(array_join(filter(good, l -> {has_word("l")}), '')) as bigint))"""
    words = "filter(split(t, '" + WORD_BREAK.replace("\\", "\\\\") + "+'), w -> w <> '')"
    failed = f"(m.n_words < {min_words} or 100 * m.n_repeat_words > {MAX_REPEATED_PERCENT} * m.n_words)"
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lost = "((m.chars - m.left) / greatest(1L, m.chars))"
    verdict = f"""named_struct({", ".join(f"'{n}', m.{n}" for n in names)}, 'base_failed', {failed}, 'kept', not {failed} and {lost} <= {max_lost}, 'lost_share', {lost}{", 'text', array_join(good, chr(10))" if with_text else ""})"""
    inner = _let(f"filter(whole, l -> {has_word('l')})", "lines", _let(f"filter(whole, l -> not {_line_fails('l', 'g')})", "good", _let(body, "m", verdict)))
    return F.expr(_let(f"coalesce(cast(`{text}` as string), '')", "t", _let(words, "words", _let(_gates("t"), "g", _let(r"split(t, '\\n')", "whole", inner)))))


def clean_text(text: str = "text") -> Column:
    """The text without its failed lines (null stays null)."""
    return F.when(F.col(text).isNotNull(), measures(text, with_text=True).getField("text"))


def keep_good(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS, cleaned: bool = False) -> DataFrame:
    """The documents that pass, with all their columns; cleaned: their text without its failed lines."""
    m = fresh(docs, "measured")
    verdict = measures(text, max_lost, min_words, cleaned)
    kept = docs.withColumn(m, F.explode(F.filter(F.array(verdict), lambda v: v["kept"])))  # a generator, so that it is worked out once
    return (kept.withColumn(text, F.col(m)["text"]) if cleaned else kept).drop(m)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    m = fresh(docs, "measured")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share")
    return docs.select("doc_id", measures().alias(m)).select("doc_id", *(F.col(m)[n].alias(n) for n in names))


def _sql() -> str:
    """The same figures and verdict in DuckDB's SQL."""
    count = lambda pattern, of="l": f"length(regexp_replace({of}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g'))"
    has = lambda pattern, of="l": f"regexp_matches({of}, '{pattern.replace(chr(39), chr(39) * 2)}')"
    words = f"len(list_filter(regexp_split_to_array(l, '{_BLANKS}'), lambda w: regexp_matches(w, '{_IN_WORD}')))"
    table = f"(tables AND {has(_TABLE_ROW + '$')})"
    alone = "greatest(0, len(list_filter(regexp_split_to_array(l, '[ \\t\\r]+'), lambda w: w IN ('»', '›', '·'))) - len(list_filter(regexp_split_to_array(l, '[ \\t\\r]+'), lambda w: w IN ('«', '‹'))))"
    n, lowered = f"({count('[^|•]+')} + {alone})", "(' ' || lower(l))"
    marks = count(r"[^\p{P}]+")
    fails = f"""({count("[^" + _SYMBOL + "]+")} - CASE WHEN {table} THEN {count("[^|]+")} ELSE 0 END > {MAX_LINE_SYMBOLS} * length(l) OR (NOT {table} AND {n} >= {MIN_SEPARATORS} AND {words} <= {WORDS_A_SEPARATOR} * {n})
        OR (NOT {has(chr(92) + "p{Ll}")} AND {count("[^" + chr(92) + "p{Lu}]+")} >= {MIN_CAPITALS})
        OR (CASE WHEN {marks} = 0 THEN marked AND {words} >= {MIN_UNMARKED_WORDS} AND {has(chr(92) + "p{Lu}|" + chr(92) + "p{Ll}")} ELSE NOT {table} AND {marks} >= {MIN_MARKS} AND {marks} > {MAX_PUNCTUATION} * {count("[ " + chr(92) + "t" + chr(92) + "r]+")} END)
        OR (length(l) >= {MIN_WORDLESS} AND NOT {table} AND NOT {has(_IN_WORD)}) OR {count(_LINK)} < {1 - MAX_LINKS} * length(l)
        OR (length(l) <= {PHRASE_LINE} AND {has(_PHRASE, lowered)} AND ({words} <= {PHRASE_WORDS} OR length({lowered}) - {count(_PHRASE, lowered)} > {PHRASE_SHARE} * length({lowered})))
        OR (length(l) <= {PHRASE_LINE} AND {has(_FORM, lowered)} AND {words} <= {PHRASE_WORDS}))"""
    tables = has("(?m)" + _TABLE_ROW + chr(92) + "n" + _TABLE_ROW.removeprefix("^") + "$", "t")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines FROM documents),
e AS (SELECT *, {tables} AS tables, {MIN_UNMARKED_WORDS} * {count("[^" + chr(92) + "p{P}]+", "t")} >= len(words) AS marked FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: md5(array_to_string(words[i : i + {WINDOW - 1}], ' ')))) AS h FROM d WHERE len(words) >= {WINDOW}),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g),
s AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS covered FROM w WHERE c > 1),
r AS (SELECT doc_id, cast(sum(covered) AS BIGINT) AS n_repeat_words FROM s GROUP BY doc_id),
m AS (SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(length(array_to_string(words, '')) AS BIGINT) AS word_chars, cast(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    cast(coalesce(list_sum(list_transform(lines, lambda l: CASE WHEN {fails} THEN length(l) ELSE 0 END)), 0) AS DOUBLE) / greatest(1, coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0)) AS lost_share FROM e LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND lost_share <= {MAX_LOST} AS kept, lost_share FROM m
"""


OP6_SQL = _sql()
