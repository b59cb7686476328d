"""Line-first cleaning: rules judge every line, a document falls if it loses too much.

Per line with a word, in this order: navigation (many separators between short
items), boilerplate (fixed phrases), punctuation (most words end in symbol marks,
or repeated exclamation marks; or a longer line ends without a sentence mark and
is written in capitals only). Failing lines go. A document whose failing lines hold
more than ``most_lost`` of its words is rejected, as is one that fails the base
measures (too short, or too many words in repeated three-word windows).

Defined cases: null text has no words and fails the base; lines are what ``\\n``
separates; a line equal to an earlier one is compared with its blanks; repeated
rows repeat; an empty table gives an empty result; extra columns are ignored.
Texts are read whole; memory grows with the longest text of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import WORDS

WORD = re.compile(WORDS)
#: White space that is no blank of the contract; without it, str.split finds the same words.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Symbols, separators of navigation, marks that words of junk end in, and boilerplate.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "•", "·", ">>", "::")
SYMBOL_ENDS = ("!!", "##", "**", "$$", "%%", "&&", "<<", ">>", "==", "~~", "^^", "++", "__")
BOILERPLATE = (
    # English
    "accept cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot password",
    "forgot your password",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share on",
    "share this",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe now",
    "subscribe to",
    "terms of service",
    "terms of use",
    "we use cookies",
    # German
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "jetzt abonnieren",
    "mehr lesen",
    "nach oben",
    "nutzungsbedingungen",
    "passwort vergessen",
    "wir verwenden cookies",
    "zum inhalt springen",
    # French
    "accepter les cookies",
    "aller au contenu",
    "cliquez ici",
    "conditions d'utilisation",
    "haut de page",
    "lire la suite",
    "mot de passe oublié",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "tous droits réservés",
    # Spanish
    "aceptar cookies",
    "haga clic aquí",
    "ir al contenido",
    "leer más",
    "olvidó su contraseña",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
    "utilizamos cookies",
    "volver arriba",
)
SENTENCE_ENDS = (".", "?", "!", ":", ";", '"', "…")

MOST_LOST = 0.3
LEAST_WORDS = 50
MOST_REPEATED = 50


def words_of(text: str) -> list[str]:
    """Blank-separated words."""
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def line_rules(text: str):
    """The rules that can fail a line of this text: (name, line and its words -> whether it fails)."""
    rules = []
    separators = [x for x in SEPARATORS if x in text]
    if separators:
        count = lambda line: sum(map(line.count, separators))
        rules.append(("navigation", lambda line, words: (n := count(line)) >= 3 and 5 * n >= len(words)))
    low = text.lower()
    phrases = [x for x in BOILERPLATE if x in low]
    if phrases:
        rules.append(("boilerplate", lambda line, words: any(x in line.lower() for x in phrases)))
    ends = tuple(x for x in SYMBOL_ENDS if x in text)
    if ends:
        rules.append(("punctuation", lambda line, words: len(words) >= 3 and 2 * sum(w.endswith(ends) for w in words) > len(words)))
    rules.append(("punctuation", lambda line, words: len(words) >= 8 and line.isupper() and not words[-1].endswith(SENTENCE_ENDS)))
    return rules


def line_fails(rules, line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails."""
    return next((name for name, fails in rules if fails(line, words)), None)


def repeated_words(words: list[str]) -> int:
    """Words that stand in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[str, int] = {}
    own = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)  # where the word stood first
    pairs = own[:-1] * n + own[1:]
    if n > 2_000_000:  # keeps the triple within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * n + own[2:]
    order = np.argsort(triples, kind="stable")
    equal = triples[order][1:] == triples[order][:-1]
    twice = np.zeros(len(triples), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    in_window = np.zeros(n, bool)
    for i in range(3):
        in_window[i : i + len(triples)] |= twice
    return int(in_window.sum())


def judge_text(text: str | None, most_lost: float = MOST_LOST) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_words)."""
    text = text or ""
    rules, words, seen = line_rules(text), [], set()
    dup = lines = failed = lost = 0
    for line in text.split("\n"):
        own = words_of(line)
        if not own:
            continue
        words += own
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(rules, line, own):
            failed, lost = failed + 1, lost + len(own)
    repeat = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, dup, repeat, base_failed, not base_failed and lost <= most_lost * len(words), lines, failed, lost


def clean_text(text: str | None) -> str | None:
    """The text without its failing lines."""
    if text is None:
        return None
    rules = line_rules(text)
    return "\n".join(line for line in text.split("\n") if not (own := words_of(line)) or not line_fails(rules, line, own))


MEASURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "n_lines": pa.int64(),
    "n_failed_lines": pa.int64(),
    "lost_words": pa.int64(),
}
_SCHEMA = "doc_id long, " + ", ".join(f"{k} {'boolean' if v == pa.bool_() else 'long'}" for k, v in MEASURES.items())


def judge(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """Per document: doc_id, the measures and the verdict ``kept``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge_text(t.as_py(), most_lost) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, MEASURES.values(), strict=True)]], names=["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _SCHEMA)


def clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that stay, with their own columns and the failing lines removed from ``text``."""
    @F.pandas_udf("struct<kept:boolean,text:string>")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"kept": [judge_text(t, most_lost)[6] for t in texts], "text": [clean_text(t) for t in texts]})

    own = docs.withColumn("__cleaned", cleaned(F.col("text").cast("string"))).filter("__cleaned.kept")
    return own.withColumn("text", F.col("__cleaned.text")).drop("__cleaned")
