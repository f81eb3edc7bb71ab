"""Number words as digits: an Amount takes the words of one number as they come and says when the next one is not its own."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

# Number words and what they stand for.
ZEROS = ("o", "oh", "zero")
ONES = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 1)}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100} | {w: 1000**i for i, w in enumerate("thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split(), 1)}
ORDINALS = {"first": ("one", "st"), "second": ("two", "nd"), "third": ("three", "rd"), "fifth": ("five", "th"), "eighth": ("eight", "th"), "ninth": ("nine", "th"), "twelfth": ("twelve", "th"), "zeroth": ("zero", "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
MONEY = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}

_WORDS = {*ONES, *TENS, *SCALES}
#: Texts without any of these hold no number, and no word that goes because another one follows.
_SOME = re.compile("[0-9]|" + "|".join(sorted({*ZEROS[1:], *ONES, *TENS, *SCALES, *ORDINALS, *SIGNS, "point", "half", r"\bo\b", "ieth", "ties"})))
# Patterns that the result needs. In the one of cents, any character may stand for the point.
_HALF, _ENDING = re.compile(r"\band\s+a\s+half\b"), re.compile(r"([0-9])\s+(st|nd|rd|th|s)\b")
_BORDERS = (re.compile(r"([a-z])([0-9])"), re.compile(r"([0-9])([a-z])"))
_WITH_CENTS, _ONLY_CENTS, _ONE = re.compile(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b"), re.compile(r"[€£$]0.([0-9]{1,2})\b"), re.compile(r"\b1(s?)\b")
_NUMERAL = re.compile(r"[-+£€$¢]?([0-9]+(?:\.[0-9]+)?)")


def stem(word: str) -> tuple[str, str]:
    """A number word and its ending: plural or ordinal."""
    if word in ORDINALS:
        return ORDINALS[word]
    for ending, put in (("ieth", "y"), ("ies", "y"), ("th", ""), ("es", ""), ("s", "")):
        bare = word.removesuffix(ending) + put
        if bare != word and word.endswith(ending) and (bare in ONES or bare in TENS or bare in SCALES) and (put == "y") == (bare in TENS):
            return bare, "th" if ending.endswith("th") else "s"
    return word, ""


def _speaks(word: str | None) -> bool:
    """Whether a word has a part in numbers: it counts, or is a sign, money, percent or a word between digits."""
    return word is not None and (word in ZEROS or stem(word)[0] in {*_WORDS, "zero"} or word in SIGNS or word in MONEY or word in ("per", "percent", "and", "double", "triple", "point"))


def _digits(word: str | None) -> bool:
    return word is not None and bool(re.fullmatch(r"[0-9]+(\.[0-9]+)?", word))


class Amount:
    """One number: a whole `value` while words add up, `text` once they are read out digit by digit."""

    def __init__(self):
        self.sign, self.tail, self.value, self.text, self.closed, self.before = "", "", None, None, False, ""

    @property
    def begun(self) -> bool:
        return self.value is not None or self.text is not None

    def __str__(self) -> str:
        return self.sign + (str(self.value) if self.text is None else self.text) + self.tail

    def _spell(self, digits: str) -> None:
        # A numeral 0 gives way to what is spelt after it.
        self.text, self.value = (str(self.value) if self.value else self.text or "") + digits, None

    def _add(self, n: int, room: int) -> None:
        """`n` fills the zeros at the end of the value if there are enough, else its digits follow."""
        if self.text is None and (self.value is None or self.value % room == 0 and self.before not in ONES):
            self.value = (self.value or 0) + n
        elif n < 10 and self.before in TENS:
            self._spell("")
            self.text = self.text[:-1] + str(n)
        else:
            self._spell(str(n))

    def _scale(self, by: int) -> bool:
        if not self.begun:
            self.value = by
        elif self.text is not None or self.value == 0:
            try:
                product = Decimal(self.text or 0) * by
            except InvalidOperation:
                return False
            if product != int(product):
                return False
            self.value, self.text = int(product), None
        else:
            self.value += self.value % 1000 * (by - 1)
        return True

    def take(self, words: list[str], k: int) -> int:
        """How many words from k on belong to this number."""
        if self.closed:
            return 0
        used = self._take(words[k], words[k + 1] if k + 1 < len(words) else None)
        if used:
            self.before = words[k + used - 1]
        return used

    def _take(self, word: str, following: str | None) -> int:
        if m := _NUMERAL.fullmatch(word):
            if self.begun:
                if not (self.text or "").endswith("."):
                    return 0
                self._spell(word)
            else:
                self.sign = word[: m.start(1)] or self.sign
                whole, _, part = m[1].partition(".")
                self.value, self.text = (None, m[1]) if part.strip("0") else (int(whole), None)
            return 1
        if word in ZEROS:
            self._spell("0")
            return 1
        bare, ending = stem(word)
        if bare in ONES or bare in TENS or bare in SCALES or (bare in ZEROS and ending):
            if bare in SCALES and not self._scale(SCALES[bare]):
                return 0
            if bare in ONES:
                self._add(ONES[bare], 10 if ONES[bare] < 10 else 100)
            elif bare in TENS:
                self._add(TENS[bare], 100)
            elif bare in ZEROS:
                self._spell("0")
            self.tail, self.closed = ending, bool(ending)
            return 1
        goes_on = _speaks(following) or _digits(following)
        if word in SIGNS and not self.begun and goes_on:
            self.sign = SIGNS[word]
            return 1
        if word in ("double", "triple") and (following in ZEROS or following in ONES):
            self._spell(str(ONES.get(following, 0)) * (2 if word == "double" else 3))
            return 2
        if word == "point" and goes_on:
            # Before a word of numbers that is no digit, it is left out.
            if _digits(following) or following in ZEROS or following in ONES or following in TENS:
                self._spell(".")
            return 1
        if not self.begun:
            return 0
        if word in MONEY:
            self.sign, self.closed = MONEY[word], True
        elif word == "percent" or (word == "per" and following == "cent"):
            self.tail, self.closed = "%", True
            return 1 + (word == "per")
        elif word == "and":
            return int(self.before in SCALES and goes_on)
        else:
            return 0
        return 1


def number_words(text: str) -> str:
    """Number words as digits, with sign, money, percent, decimals and endings."""
    if not _SOME.search(text):
        return " ".join(text.split())
    parts = _HALF.split(text)
    for i, part in enumerate(parts[:-1]):
        last = (part.split() or [""])[-1]
        if last:
            parts[i] = f"{part} point five" if last in ZEROS or last in ONES or last in TENS or last in SCALES else f"{part} and a half"
    text = " ".join(parts)
    for border in _BORDERS:
        text = border.sub(r"\1 \2", text)
    words = _ENDING.sub(r"\1\2", text).split()
    out, k, amount = [], 0, Amount()
    while k < len(words):
        used = amount.take(words, k)
        if not used:
            out.append(str(amount) if amount.begun else amount.sign + words[k])
            used, amount = 0 if amount.begun else 1, Amount()
        k += used
    if amount.begun:
        out.append(str(amount))
    # Cents after a whole amount: $2 and ¢7 are $2.07.
    joined = _WITH_CENTS.sub(lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", " ".join(out))
    return _ONE.sub(r"one\1", _ONLY_CENTS.sub(lambda m: f"¢{int(m[1])}", joined))
