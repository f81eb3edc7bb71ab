"""Text normalisers. Patterns run in the JVM; only what has no built-in (Unicode forms, number words, zlib) is an
Arrow-batched pandas UDF."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loquent.functions.numbers import number_words

# Letters that do not come apart by NFKD.
LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
_LETTERS = str.maketrans(LETTERS)
# Fillers and contractions, in the order in which they apply.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
CONTRACTIONS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"), (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"),
    (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"), (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "),
    (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "), (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "), (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
)
def _each(texts: pd.Series, f) -> pd.Series:
    return texts.map(lambda t: None if t is None else f(t))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return _each(texts, lambda t: unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return _each(texts, lambda t: unicodedata.normalize("NFKD", t).translate(_LETTERS))


def _spaced(text: Column, keep: str = "") -> Column:
    """Marks, symbols and punctuation but those of `keep` as spaces."""
    return F.regexp_replace(text, r"[\p{M}\p{S}\p{P}" + (f"&&[^{keep}]" if keep else "") + "]", " ")


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def without_symbols(text: Column | str) -> Column:
    """NFKC; marks, symbols and punctuation become spaces."""
    return _spaced(_composed(_column(text)))


def without_diacritics(text: Column | str) -> Column:
    """NFKD without diacritics; other marks, symbols and punctuation become spaces."""
    return _spaced(F.regexp_replace(_decomposed(_column(text)), r"\p{Mn}", ""))


def _english_bare(text: Column) -> Column:
    return _spaced(F.regexp_replace(_decomposed(text), r"\p{Mn}", ""), ".%$¢€£")


def _brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")


def basic(text: Column, diacritics: bool = True, letters: bool = False) -> Column:
    """Lower case, no bracketed words, no symbols, single spaces; with letters, graphemes apart."""
    out = F.lower((without_symbols if diacritics else without_diacritics)(_brackets(text)))
    if letters:
        out = graphemes(out)
    return F.regexp_replace(out, r"\s+", " ")


def graphemes(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(\X)"), 1), " ")


def contractions(text: Column) -> Column:
    """Fillers and contractions, then marks between and after digits (T5)."""
    out = F.regexp_replace(F.regexp_replace(_brackets(text), FILLERS, ""), r"\s+'", "'")
    for pattern, to in CONTRACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(F.regexp_replace(out, r"([0-9]),([0-9])", "$1$2"), r"\.([^0-9]|$)", " $1")


def english(text: Column) -> Column:
    """The English normaliser without a spelling map (T5-T7); give one to functions.strings.spelling."""
    out = numbers(_english_bare(contractions(text)))
    out = F.regexp_replace(F.regexp_replace(out, r"[.$¢€£]([^0-9])", " $1"), r"([^0-9])%", "$1 ")
    return F.regexp_replace(out, r"\s+", " ")


@F.pandas_udf(StringType())
def numbers(texts: pd.Series) -> pd.Series:
    return _each(texts, number_words)


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Bytes over zlib bytes."""
    return texts.map(lambda t: None if t is None else len(t.encode()) / len(zlib.compress(t.encode())))


def signature(key: str) -> Callable[[str], Column]:
    """HMAC-SHA256 of a column in hex (T21, B22): a digest around a digest, each with the key's own pad. Null stays null."""
    held = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in held.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return lambda column: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(column, "UTF-8")), 256))), 256)


def sentences(text: Column) -> Column:
    """Split after sentence marks (T16): the built-in splitter for any language."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
