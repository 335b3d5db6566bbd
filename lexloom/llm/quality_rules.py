"""Line-first quality rules (operator 1), built-in functions only.

Every line is judged on its own by punctuation, navigation, symbol and boilerplate rules, failing lines are removed, and a
document that loses too large a share of its words is rejected. Document-level base counts are reported beside the verdict.

Punctuation: a line passes if it ends in a sentence mark of any script (closing quotes and brackets aside; three dots or an
ellipsis only break a line off), or if it is long and has a sentence end inside. Navigation: separators, or capitalised menu
words that make up a good part of a short line. Boilerplate: short lines with a phrase of the list below, as whole words.

Defined edge cases: a null text has no lines and no words (all counts 0, base_failed, not kept); an empty text likewise.
Texts of any length are one row and are read whole; equal lines and equal rows are judged alike. Other columns of the input
pass through `clean_documents` untouched and never clash: they travel in one struct beside the working columns. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import WS, packed, unpacked, words_of

# Phrases that mark a short line as page furniture, in lower case (en, de, fr, es, hi).
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on",
    "lorem ipsum", "privacy policy", "sign in", "sign up", "skip to content", "subscribe now", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt abonnieren",
    "cliquez ici", "conditions d.utilisation", "politique de confidentialité", "tous droits réservés",
    "haga clic aquí", "política de privacidad", "términos de uso", "todos los derechos reservados",
    "गोपनीयता नीति", "यहाँ क्लिक करें", "सर्वाधिकार सुरक्षित",
)

# Words of menus, as they are written there (en, de, fr, es, hi).
MENU = (
    "Home", "About", "Contact", "Login", "Logout", "Register", "Search", "Menu", "Jobs", "Careers", "News", "Blog", "FAQ", "Help",
    "Sitemap", "Privacy", "Imprint", "Cart", "Checkout", "Account", "Share", "Print", "Next", "Previous",
    "Startseite", "Impressum", "Kontakt", "Anmelden", "Datenschutz", "Suche", "Hilfe", "Warenkorb",
    "Accueil", "Connexion", "Recherche", "Panier", "Aide",
    "Inicio", "Contacto", "Buscar", "Carrito", "Ayuda",
    "होम", "संपर्क", "खोजें",
)

# Sentence marks: Latin, Greek, Armenian, Arabic, Urdu, Devanagari, Myanmar, Khmer, Ethiopic, Mongolian, Chinese and Japanese.
MARKS = r".!?\x{37E}\x{589}\x{61F}\x{6D4}\x{964}\x{965}\x{104A}\x{104B}\x{17D4}\x{17D5}\x{1362}\x{1367}\x{1803}\x{203C}\x{203D}\x{3002}\x{FF01}\x{FF0E}\x{FF1F}\x{FF61}"
# What may close a sentence after its mark.
CLOSERS = r"\x{22}'\)\]\}\x{BB}\x{2019}\x{201D}\x{203A}\x{300D}\x{300F}\x{FF09}"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict."""

    #: the end of a line that ends in a sentence, and a broken-off end
    sentence_end: str = rf"[{MARKS}][{CLOSERS}{WS}]*$"
    broken_end: str = rf"(\.\.|\x{{2026}})[{CLOSERS}{WS}]*$"
    #: a sentence end inside a line, and the words from which on it is enough
    inner_end: str = rf"[{MARKS}][{CLOSERS}]*[{WS}]|[\x{{3002}}\x{{FF01}}\x{{FF1F}}\x{{964}}]"
    long_line: int = 15
    symbols: str = r"[#*$%&|<>]"
    #: what every mark that is counted holds at least one of; lines without any are not searched for each kind
    any_mark: str = r"[#*$%&|<>!?\x{00BB}\x{203A}\x{2022}]"
    #: a line with more symbols than this per 100 words fails
    symbols_per_100: int = 50
    #: a line with more `!` and `?` than this per 100 words fails
    shouts_per_100: int = 60
    #: a line with so many `|`, `>` or bullet separators is navigation
    nav_marks: int = 3
    nav: str = r"[|\x{00BB}\x{203A}\x{2022}]|>>"
    #: so is a short line with so many menu words, at least this share (in 100) of its words
    menu_words: int = 3
    menu_per_100: int = 30
    menu: str = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(MENU)})(?:$|[^\p{{L}}\p{{M}}\p{{N}}])"
    boilerplate: str = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(BOILERPLATE)})(?:$|[^\p{{L}}\p{{M}}\p{{N}}])"
    #: menu words and boilerplate phrases count in lines of at most so many words
    short_line: int = 40
    #: a document that loses more than this share of its words (in 100) is rejected
    lost_per_100: int = 50
    min_words: int = 50


def _line_fails(line: Column, n: Column, r: Rules) -> Column:
    """Whether a line of n words fails."""
    ended = (line.rlike(r.sentence_end) & ~line.rlike(r.broken_end)) | ((n >= r.long_line) & line.rlike(r.inner_end))
    menu = F.regexp_count(line, F.lit(r.menu))
    furniture = ((menu >= r.menu_words) & (100 * menu >= r.menu_per_100 * n)) | F.lower(line).rlike(r.boilerplate)
    marked = (
        (F.regexp_count(line, F.lit(r.nav)) >= r.nav_marks)
        | (100 * F.regexp_count(line, F.lit(r.symbols)) > r.symbols_per_100 * n)
        | (100 * F.regexp_count(line, F.lit("[!?]")) > r.shouts_per_100 * n)
    )
    return ~ended | (line.rlike(r.any_mark) & marked) | ((n <= r.short_line) & furniture)


def with_measures(df: DataFrame, text: str = "text", rules: Rules = Rules(), out: str = "_q") -> DataFrame:
    """Add one struct column `out` with the base counts, the kept lines and the verdict."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Each step reads the step before it at least twice, so that the optimizer keeps it as a column of its own and a
    # lambda never recomputes it for every element.
    df = df.withColumn(out, F.struct(words_of(F.col(text)).alias("w"), F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("l")))
    w, n = F.col(f"{out}.w"), F.size(f"{out}.w")
    # Hash of each 3-word window, in order of place.
    triple = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple))
    counted = F.transform(F.col(f"{out}.l"), lambda x: F.struct(x.alias("t"), F.regexp_count(x, F.lit(f"[^{WS}]+")).alias("n")))
    lines = F.transform(counted, lambda x: F.struct(x["t"].alias("t"), _line_fails(x["t"], x["n"], rules).alias("f"), x["n"].alias("n")))
    df = df.withColumn(
        out,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(f"{out}.l") - F.size(F.array_distinct(f"{out}.l"))).cast("long").alias("n_dup_lines"),
            w.alias("w"),
            windows.alias("s"),
            lines.alias("l"),
        ),
    )
    # Only texts with a repeated hash are sorted: windows that occur twice become neighbours.
    s = F.col(f"{out}.s")
    placed = F.sort_array(F.transform(s, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    fields = [F.col(f"{out}.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "w", "l")]
    df = df.withColumn(out, F.struct(*fields, F.when(F.size(F.array_distinct(s)) < F.size(s), placed).alias("s")))
    s, w = F.col(f"{out}.s"), F.col(f"{out}.w")
    # Neighbours by hash are compared word by word.
    same = lambda a, b: (a["h"] == b["h"]) & (F.get(w, a["p"]) == F.get(w, b["p"])) & (F.get(w, a["p"] + 1) == F.get(w, b["p"] + 1)) & (F.get(w, a["p"] + 2) == F.get(w, b["p"] + 2))
    pairs = F.zip_with(
        s,
        F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
        lambda a, b: F.when(
            same(a, b),
            F.array(a["p"], a["p"] + 1, a["p"] + 2, b["p"], b["p"] + 1, b["p"] + 2),
        ),
    )
    kept = F.filter(F.col(f"{out}.l"), lambda x: ~x["f"])
    lost = F.aggregate(F.col(f"{out}.l"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["f"], x["n"]).otherwise(0))
    fields = {k: F.col(f"{out}.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    df = df.withColumn(
        out,
        F.struct(
            *[v.alias(k) for k, v in fields.items()],
            F.coalesce(F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(f"{out}.l").cast("long").alias("n_lines"),
            F.size(kept).cast("long").alias("n_kept_lines"),
            lost.alias("lost_words"),
            F.array_join(F.transform(kept, lambda x: x["t"]), "\n").alias("clean_text"),
        ),
    )
    g = lambda k: F.col(f"{out}.{k}")
    base_failed = (g("n_words") < rules.min_words) | (100 * g("n_repeat_words") > 50 * g("n_words"))
    return df.withColumn(
        out,
        F.struct(*[g(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kept_lines", "lost_words", "clean_text")], base_failed.alias("base_failed"), (~base_failed & (100 * g("lost_words") <= rules.lost_per_100 * g("n_words"))).alias("kept")),
    )


def quality_report(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: base counts, line counts and verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kept_lines", "lost_words", "base_failed", "kept")
    return with_measures(df.select("doc_id", "text"), rules=rules).select("doc_id", *[F.col(f"_q.{k}") for k in names])


def clean_documents(df: DataFrame, rules: Rules = Rules(), n_chars: str | None = "n_chars") -> DataFrame:
    """Kept documents with their failing lines removed; the columns of df stay as they are otherwise."""
    cols = df.columns
    # A filter on the verdict would be pushed below the measures and compute them twice; the rows of a generator are
    # filtered above it.
    out = with_measures(packed(df, "text"), rules=rules)
    out = out.withColumn("_kept", F.explode_outer(F.when(F.col("_q.kept"), F.array(F.struct(F.col("_q.clean_text").alias("text"))))))
    out = out.filter("_kept is not null")
    new = {"text": F.col("_kept.text")}
    if n_chars in cols:
        new[n_chars] = F.length("_kept.text").cast(df.schema[n_chars].dataType)
    return unpacked(out, cols, **new)


def sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL of quality_report over `documents`."""
    word = f"'[^{WS}]+'"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    fails = f"""(NOT (regexp_matches(l, {quoted(rules.sentence_end)}) AND NOT regexp_matches(l, {quoted(rules.broken_end)}) OR c >= {rules.long_line} AND regexp_matches(l, {quoted(rules.inner_end)}))
        OR len(regexp_extract_all(l, '{rules.nav}')) >= {rules.nav_marks}
        OR 100 * len(regexp_extract_all(l, '{rules.symbols}')) > {rules.symbols_per_100} * c
        OR 100 * len(regexp_extract_all(l, '[!?]')) > {rules.shouts_per_100} * c
        OR c <= {rules.short_line} AND (len(regexp_extract_all(l, {quoted(rules.menu)})) >= {rules.menu_words} AND 100 * len(regexp_extract_all(l, {quoted(rules.menu)})) >= {rules.menu_per_100} * c
          OR regexp_matches(lower(l), {quoted(rules.boilerplate)})))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dups, count(*) FILTER (NOT f) AS n_kept,
       coalesce(sum(c) FILTER (f), 0) AS lost
       FROM (SELECT doc_id, l, c, {fails} AS f FROM (SELECT doc_id, l, len(regexp_extract_all(l, {word})) AS c FROM l WHERE regexp_matches(l, '[^{WS}]'))) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_kept, 0)::BIGINT AS n_kept_lines, coalesce(lost, 0)::BIGINT AS lost_words
      FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lw ON lw.doc_id = d.doc_id),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_words <= {rules.lost_per_100} * n_words AS kept FROM v"""
