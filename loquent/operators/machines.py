"""Small state machines for order-dependent operators. Each takes one row at a time and gives the rows that follow from it.

They are plain Python and hold bounded state, so the batch fold and the streaming operator run the same code.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Agreement:
    """Commits what two hypotheses in a row agree on (S1), dropping what was committed before.

    Rows: (hyp, pos, start, end, text, probability). A hypothesis is complete when the next one begins or on close. A row
    without text is a silence after its hypothesis.
    """

    sure: float | None = None
    policy: str = "pad"
    keep: int = 200
    committed: list = field(default_factory=list)
    pending: list = field(default_factory=list)
    new: list = field(default_factory=list)
    last: float = 0.0
    hyp: int | None = None

    def push(self, row: tuple) -> list:
        out = self._flush() if self.hyp is not None and row[0] != self.hyp else []
        self.hyp = row[0]
        if row[4] is None:
            return out + self._flush() + self.silence(row[3] - row[2], self.policy)
        self.new.append(row)
        return out

    def _flush(self) -> list:
        if not self.new:
            return []
        fresh = [t for t in self.new if t[2] > self.last - 0.1]
        if fresh and self.committed and abs(fresh[0][2] - self.last) < 1:
            for n in range(1, min(5, len(fresh), len(self.committed)) + 1):
                if [t[4] for t in self.committed[-n:]] == [t[4] for t in fresh[:n]]:
                    fresh = fresh[n:]
                    break
        out, k = [], 0
        for token in fresh:
            certain = self.sure is not None and token[5] is not None and token[5] > self.sure
            if not certain and (k >= len(self.pending) or self.pending[k][4] != token[4]):
                break
            out.append(token)
            self.last = token[3]
            k += 1
        self.pending, self.new = fresh[len(out) :], []
        self.committed = (self.committed + out)[-self.keep :]
        return [(*t, True) for t in out]

    def silence(self, seconds: float, policy: str = "pad") -> list:
        """A stretch of silence (S27): pad or offset moves time on, flush gives up what is pending if it is long."""
        if policy == "flush" and seconds >= 5:
            out = self._flush() + [(*t, False) for t in self.pending]
            self.pending, self.committed = [], []
            self.last += seconds
            return out
        self.last += seconds if policy == "offset" else 0
        return []

    def close(self) -> list:
        """The last hypothesis, and then what was never agreed on."""
        return self._flush() + [(*t, False) for t in self.pending]


@dataclass
class Trim:
    """Where the buffer of a stream is cut after an iteration (S3). Rows: (iteration, kind, at, text); of an iteration
    committed tokens, ends of segments, and last how far the audio goes ("token", "segment", "upto").

    A buffer over `limit` seconds is cut at the end of the last sentence but one, or of the last committed segment, else at
    the last committed token, and without any in its middle. Committed tokens that end by then are forgotten (S2). Nothing
    is committed for `limit` seconds: the buffer begins anew.
    """

    limit: float = 15.0
    way: str = "sentence"
    offset: float = 0.0
    output: float = 0.0
    tokens: list = field(default_factory=list)
    ends: list = field(default_factory=list)
    fresh: bool = False

    def push(self, row: tuple) -> list:
        iteration, kind, at, text = row
        if kind == "token":
            self.tokens.append((at, text))
            self.output, self.fresh = at, True
            return []
        if kind == "segment":
            self.ends.append(at)
            return []
        cut, reason = self._cut(at)
        self.ends, self.fresh = [], False
        if cut is None:
            return []
        before = len(self.tokens)
        self.tokens = [] if reason == "anew" else [t for t in self.tokens if t[0] > cut]
        self.offset = cut
        return [(iteration, cut, before - len(self.tokens), reason)]

    def _cut(self, upto: float) -> tuple[float | None, str]:
        size = upto - self.offset
        if not self.fresh and size > self.limit and upto - self.output > self.limit:
            return upto, "anew"
        by_sentence = self.way == "sentence" and self.fresh and size > self.limit
        if not by_sentence and size <= (30.0 if self.way == "sentence" else self.limit):
            return None, ""
        if not self.tokens:
            return self.offset + size / 2, "half"
        last = self.tokens[-1][0]
        if by_sentence:
            marks = [at for at, text in self.tokens if text.rstrip().endswith((".", "!", "?"))]
            # What stands after the last mark counts as a sentence.
            done = marks if marks and marks[-1] < last else marks[:-1]
            if done:
                return done[-1], "sentence"
        else:
            done = [e for e in self.ends[:-1] if e <= last]
            if done:
                return done[-1], "segment"
        return last, "committed"

    def close(self) -> list:
        return []


@dataclass
class Recent:
    """The newest segments of at most `most` together, one at least (S6). Rows: (seq, size). Gives how many there are and
    how much was removed before them."""

    most: int
    kept: list = field(default_factory=list)
    removed: int = 0

    def push(self, row: tuple) -> list:
        self.kept.append(row[1])
        while len(self.kept) > 1 and sum(self.kept) > self.most:
            self.removed += self.kept.pop(0)
        return [(row[0], len(self.kept), self.removed)]

    def close(self) -> list:
        return []


@dataclass
class VoiceActivity:
    """Starts at `high`, ends below `low` after `quiet` samples, both padded (S8). Rows: (sample, probability)."""

    high: float = 0.5
    low: float = 0.35
    quiet: int = 8000
    pad: int = 1600
    on: bool = False
    since: int = 0

    def push(self, row: tuple) -> list:
        at, p = row
        if p >= self.high:
            self.since = 0
            if not self.on:
                self.on = True
                return [("start", at - self.pad)]
        elif p < self.low and self.on:
            self.since = self.since or at
            if at - self.since >= self.quiet:
                end, self.since, self.on = self.since + self.pad, 0, False
                return [("end", end)]
        return []

    def close(self) -> list:
        return []


@dataclass
class Breaker:
    """Circuit breaker (S13). Rows: (seconds, ok). With clear, a success while closed forgets failures; `trials`
    successes in a row close a half-open circuit. Gives the state before each call and whether it was let through."""

    failures: int = 5
    rest: float = 60.0
    clear: bool = False
    trials: int = 1
    state: str = "closed"
    bad: int = 0
    good: int = 0
    since: float = 0.0

    def push(self, row: tuple) -> list:
        at, ok = row
        if self.state == "open":
            if at - self.since < self.rest:
                return [(at, "open", False)]
            self.state, self.good = "half_open", 0
        out = [(at, self.state, True)]
        if ok:
            if self.state == "half_open":
                self.good += 1
                if self.good >= self.trials:
                    self.state, self.bad = "closed", 0
            elif self.clear:
                self.bad = 0
        else:
            self.bad += 1
            self.since = at
            if self.state == "half_open" or self.bad >= self.failures:
                self.state = "open"
        return out

    def close(self) -> list:
        return []


@dataclass
class Restarts:
    """Exact restart policy (W15): denied attempts do not count. Rows: (seconds,). Gives whether each may restart."""

    most: int = 3
    window: float = 86400.0
    times: list = field(default_factory=list)

    def push(self, row: tuple) -> list:
        self.times = [t for t in self.times if row[0] - t < self.window]
        allowed = len(self.times) < self.most
        if allowed:
            self.times.append(row[0])
        return [(row[0], allowed)]

    def close(self) -> list:
        return []


@dataclass
class Lines:
    """Lines by speaker (W7): a change takes effect at punctuation or silence; else the token stays with its line.

    Rows: (seq, start, end, text, speaker).
    """

    sep: str = " "
    line: tuple | None = None
    number: int = 0
    after_mark: bool = False

    def push(self, row: tuple) -> list:
        _, start, end, text, speaker = row
        mark = text.strip() in (".", "!", "?")
        first, split = self.line is None, False
        if not first:
            own = self.line[3]
            split = speaker != own and (self.after_mark or -2 in (speaker, own))
        self.after_mark = mark
        if first or split:
            out = self._done()
            self.line = (start, end, text, speaker)
            return out
        self.line = (self.line[0], end if text else self.line[1], self.line[2] + (self.sep + text if text else ""), self.line[3])
        return []

    def _done(self) -> list:
        if self.line is None:
            return []
        out = [(self.number, *self.line)]
        self.number += 1
        return out

    def close(self) -> list:
        return self._done()


@dataclass
class SpeakerLines:
    """Lines of a transcript with speakers (W7, S29). Rows: (start, end, text, speaker, horizon, last speaker of the stream).

    Without `attributed` speakers -1 counts as 1. With them, a token without speaker belongs to the line before it, or, past
    the horizon of attribution, waits outside the lines; unless the stream ends in silence. A change of speaker begins a
    line right after a mark, or if one of the two is silence; else the token stays. `behind` says how far a line is past
    the last attributed moment. Waiting tokens come last, as line -1.
    """

    attributed: bool = True
    line: list | None = None
    number: int = 0
    after_mark: bool = False
    known: float = 0.0
    owner: int = -1
    waiting: list = field(default_factory=list)

    def push(self, row: tuple) -> list:
        start, end, text, speaker, horizon, last = row
        marked, self.after_mark = self.after_mark, False
        if not self.attributed:
            speaker = 1 if speaker == -1 else speaker
        elif last != -2:
            if speaker in (-1, 0) and end >= horizon:
                self.waiting.append((start, end, text))
                return []
            speaker = self.owner if speaker in (-1, 0) else speaker
            self.known = max(end, self.known) if speaker not in (-1, 0) else self.known
        behind = round(end - self.known, 2)
        if self.line is None:
            self.line = [start, end, text, speaker, behind]
            return []
        self.owner = self.line[3]
        self.after_mark = text.strip() in (".", "!", "?")
        if speaker != self.owner and (-2 in (speaker, self.owner) or marked and not self.after_mark):
            out, self.line = [(self.number, *self.line)], [start, end, text, speaker, behind]
            self.number += 1
            return out
        if text:
            self.line[1:3], self.line[4] = [end, f"{self.line[2]} {text}"], behind
        return []

    def close(self) -> list:
        out = [] if self.line is None else [(self.number, *self.line)]
        if self.waiting:
            out.append((-1, self.waiting[0][0], self.waiting[-1][1], " ".join(w[2] for w in self.waiting), -1, 0.0))
        return out


@dataclass
class Blanks:
    """Tokens of a blank marker become one row of silence if they last long enough (W5). Rows: (seq, start, end, text)."""

    least: float = 4.0
    run: tuple | None = None

    def _end(self) -> list:
        run, self.run = self.run, None
        return [(run[0], run[1], run[2], "", -2)] if run and run[2] - run[1] >= self.least else []

    def push(self, row: tuple) -> list:
        seq, start, end, text = row
        if text.strip() in ("[BLANK_AUDIO]", "[typing]"):
            self.run = (seq, start, end) if self.run is None else (self.run[0], min(self.run[1], start), max(self.run[2], end))
            return []
        return [*self._end(), (seq, start, end, text, -1)]

    def close(self) -> list:
        return self._end()


@dataclass
class Gaps:
    """A row of silence before each token that begins at least `least` after the one before it, or after 0 (W3). Rows:
    (seq, start, end, text, speaker)."""

    least: int
    last: int = 0

    def push(self, row: tuple) -> list:
        seq, start, end, _, _ = row
        silent = start is not None and start - self.last >= self.least
        out = [row, (seq, self.last, start, "", -2)] if silent else [row]
        self.last = end or 0
        return out

    def close(self) -> list:
        return []


@dataclass
class Cues:
    """Subtitle cues from timed words: lines of at most `width`, `lines` lines a cue, a new cue after a pause (T19). Rows:
    (start, end, text)."""

    width: int = 42
    lines: int = 2
    pause: float = 3.0
    text: str = ""
    used: int = 0
    rows: int = 1
    begin: float = 0.0
    last: float | None = None
    number: int = 0

    def push(self, row: tuple) -> list:
        start, end, bare = row
        out, word = [], " " + bare
        fits = self.used + len(word) <= self.width
        if self.last is None or start - self.last > self.pause or (not fits and self.rows >= self.lines):
            out = self.close()
            self.text, self.used, self.rows, self.begin = word.lstrip(), len(word.lstrip()), 1, start
        elif fits:
            self.text, self.used = self.text + word, self.used + len(word)
        else:
            self.text, self.used, self.rows = self.text + "\n" + word.lstrip(), len(word.lstrip()), self.rows + 1
        self.last = end
        return out

    def close(self) -> list:
        if not self.text:
            return []
        self.number += 1
        return [(self.number - 1, self.begin, self.last, self.text.strip())]


@dataclass
class Monotonic:
    """Starts at least `gap` after the last end, ends not before starts (W9). Rows: (seq, start, end)."""

    gap: float = 0.01
    last: float | None = None

    def push(self, row: tuple) -> list:
        seq, start, end = row
        if self.last is not None and start < self.last:
            start = self.last + self.gap
        end = max(start, end)
        self.last = end
        return [(seq, start, end)]

    def close(self) -> list:
        return []


@dataclass
class Sentences:
    """Tokens up to a sentence end make a sentence (W16). Rows: (seq, start, end, text)."""

    words: list = field(default_factory=list)
    times: tuple | None = None
    number: int = 0

    def push(self, row: tuple) -> list:
        _, start, end, text = row
        self.times = (start, end) if self.times is None else (self.times[0], end)
        self.words.append(text)
        return self.close() if text.rstrip().endswith((".", "!", "?")) else []

    def close(self) -> list:
        if not self.words:
            return []
        out = [(self.number, *self.times, " ".join(self.words))]
        self.words, self.times, self.number = [], None, self.number + 1
        return out


@dataclass
class Truncate:
    """Words at a sentence edge last at most twice the usual length (W19). Rows: (seq, start, end, text)."""

    usual: float = 0.35
    mark: bool = True

    def push(self, row: tuple) -> list:
        seq, start, end, text = row
        most, is_mark = 2 * self.usual, text.strip() in (".", "!", "?", "。", "！", "？")
        if end - start > most:
            if is_mark:
                end = start + most
            elif self.mark:
                start = end - most
        self.mark = is_mark
        return [(seq, start, end, text)]

    def close(self) -> list:
        return []


@dataclass
class Idle:
    """Tells of keys without rows (S19): (last, noticed), when the next row or the end shows it, or a timer does.

    Rows: (at,) in milliseconds. `quiet` is what a timer calls; the machine itself needs none if rows come in order.
    """

    patience: int
    timed: bool = False
    last: int | None = None

    def push(self, row: tuple) -> list:
        out = [] if self.timed or self.last is None or row[0] - self.last <= self.patience else self.quiet(self.last, self.last + self.patience)
        self.last = row[0]
        return out

    def quiet(self, last: int, noticed: int) -> list:
        return [(last, noticed)]

    def close(self) -> list:
        return [] if self.timed or self.last is None else self.quiet(self.last, self.last + self.patience)


@dataclass
class NoOutput:
    """Starts a buffer anew that grows for longer than `limit` without output (S4): (at, begin of the buffer).

    Rows: (at, whether it is output). After a reset the time of the last output counts as long ago.
    """

    limit: float
    begin: float | None = None
    last: float | None = None

    def push(self, row: tuple) -> list:
        at, output = row
        if self.begin is None:
            self.begin = at
        if output:
            self.last = at
        elif at - self.begin > self.limit and (self.last is None or at - self.last > self.limit):
            out = [(at, self.begin)]
            self.begin, self.last = at, None
            return out
        return []

    def close(self) -> list:
        return []
