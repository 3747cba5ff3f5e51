r"""Quality rules that clean lines first and judge the document by what they leave.

Each line with a word is put to the rules of `RULES` in order and removed by the first that it fails:

* repeated: it equals an earlier line of the document;
* punctuation: too many signs a word, too many capitals or shouts, or, in a line of `LONG_LINE` words or more, no mark that
  ends or parts a sentence;
* navigation: too many separators a word, or too few different words;
* boilerplate: a short line with a phrase of a notice, in one of the languages of `BOILERPLATE`.

A document is then rejected if the rest holds too small a share of its words, or if the document as a whole is short or
repeats itself. Words are `[^\x20\x09-\x0D]+`.

A null or empty text has no words: all counts are 0, nothing is removed and the document is rejected. A text of any length is
judged whole, in one task. Rows are judged one by one, so ties, repeated rows and extra columns change nothing; an empty table
gives an empty table. A column named as the result is replaced.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import values

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
# Phrases of notices, by language.
BOILERPLATE = {
    "en": (
        "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "javascript",
        "subscribe", "click here", "sign up", "log in", "read more", "share this", "powered by",
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "abonnieren", "hier klicken",
        "anmelden", "weiterlesen", "mehr lesen", "teilen auf",
    ),
    "fr": (
        "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "abonnez-vous",
        "cliquez ici", "se connecter", "lire la suite", "partager sur",
    ),
    "es": (
        "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "suscríbete", "haga clic",
        "iniciar sesión", "leer más", "compartir en",
    ),
}
PHRASES = tuple(p for phrases in BOILERPLATE.values() for p in phrases)
SEPARATORS = ("|", "·", "•", "»", "→")
SENTENCE_MARKS = re.compile(r"[.,;:!?…。]")
RULES = ("repeated", "punctuation", "navigation", "boilerplate")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: From so many words on, a line has to have a mark that ends or parts a sentence; up to so many, it may be boilerplate.
LONG_LINE, SHORT_LINE = 12, 12
#: A line fails with more symbols or separators a word, or a larger share of capitals or of repeated words, than these.
MAX_SYMBOLS, MAX_PIPES, MAX_CAPITALS, MAX_SHOUTS, LEAST_DISTINCT = 0.3, 0.2, 0.5, 0.3, 0.2
#: The share of a document's words that has to survive the cleaning.
LEAST_KEPT = 0.6

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_kept_words", pa.int64()), ("n_lines_removed", pa.int64()), ("cleaned", pa.string()),
]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def punctuation_fails(line: str, raw: bytes, n: int) -> bool:
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if symbols > MAX_SYMBOLS * n and (n >= 4 or symbols >= n):
        return True
    if n > 3:
        capitals, letters = len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, LETTERS))
        if capitals > MAX_CAPITALS * letters or raw.count(b"!") > MAX_SHOUTS * n:
            return True
    return n >= LONG_LINE and not SENTENCE_MARKS.search(line)


def navigation_fails(line: str, words: list[bytes]) -> bool:
    n = len(words)
    if n > 3 and sum(map(line.count, SEPARATORS)) > MAX_PIPES * n:
        return True
    return n >= 10 and len(set(words)) < LEAST_DISTINCT * n


def boilerplate_fails(line: str, n: int) -> bool:
    if n > SHORT_LINE:
        return False
    low = line.lower()
    return any(p in low for p in PHRASES)


def line_fails(line: str, raw: bytes, words: list[bytes]) -> str | None:
    """The rule that removes the line."""
    if punctuation_fails(line, raw, len(words)):
        return "punctuation"
    if navigation_fails(line, words):
        return "navigation"
    return "boilerplate" if boilerplate_fails(line, len(words)) else None


def judge(text: str) -> tuple:
    """The values of FIELDS. bytes.split() cuts at exactly the ASCII blanks that separate words here."""
    words, kept, seen, n_kept, dups, lines = [], [], set(), 0, 0, 0
    for line in text.split("\n"):
        raw = line.encode("utf-8", "replace")
        own = raw.split()
        if not own:
            continue
        lines += 1
        words += own
        if line in seen:
            dups += 1
            continue
        seen.add(line)
        if not line_fails(line, raw, own):
            kept.append(line)
            n_kept += len(own)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), dups, repeated_words(words), n_kept, lines - len(kept), "\n".join(kept)


def apply_rules(df: DataFrame, text_col: str = "text", out_col: str = "quality", with_text: bool = True) -> DataFrame:
    """`df` with `out_col`, a struct: the counts, the `cleaned` text if it is wanted, and the verdicts `base_failed` and
    `kept`."""
    fields = FIELDS if with_text else FIELDS[:-1]

    @F.arrow_udf(", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [judge(t or "")[: len(fields)] for t in values(texts)]
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            yield pa.StructArray.from_arrays(cols, names=[n for n, _ in fields])

    q = F.col(out_col)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    kept = ~failed & (q["n_kept_words"] >= LEAST_KEPT * q["n_words"])
    return df.withColumn(out_col, run(F.col(text_col))).withColumn(out_col, q.withField("base_failed", failed).withField("kept", kept))
