"""Queries without SQL against plain Python on the small tables, and their machines on cases with known results."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import pytest

from loquent.functions import normalize as T
from loquent.functions.numbers import number_words
from loquent.operators import folds as D
from loquent.operators import machines as M
from loquent.operators import sequences as Q
from loquent.plans import catalog
from loquent.plans import folds_queries as P
from loquent.plans import transcript_queries as R
from loquent.plans.registry import Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: catalog.queries()[name](spark, sf_dir)


@pytest.fixture(scope="module")
def timed(t):
    """seq, start, end, text and speaker of each stream's tokens, in order."""
    out = defaultdict(list)
    for r in P.timed(t).orderBy("stream_id", "seq").collect():
        out[r.stream_id].append((r.seq, r.start, r.end, r.text, r.speaker))
    return out


def by_machine(df, key, order, inputs, machine):
    """What the machine gives for each key's rows in order, without Spark's folds."""
    groups = defaultdict(list)
    for r in df.collect():
        groups[r[key]].append((tuple(r[c] for c in order), tuple(r[c] for c in inputs)))
    out = []
    for k, rows in groups.items():
        own = machine()
        for _, row in sorted(rows, key=lambda x: x[0]):
            out += [(k, *x) for x in own.push(row)]
        out += [(k, *x) for x in own.close()]
    return sorted(out, key=str)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=str)


HYP = ["hyp_id", "pos", "start", "end", "text", "probability"]


def test_agreement(run, t):
    want = by_machine(P.hypotheses(t), "stream_id", ["hyp_id", "pos"], HYP, M.Agreement)
    assert rows(run("s1_local_agreement")) == want
    assert rows(run("s5_end_of_stream")) == [r for r in want if not r[-1]]
    # What is committed is what two hypotheses in a row begin with; each word once, in order.
    whole = {k: [x[4] for x in v if x[0] == 4] for k, v in group(P.hypotheses(t), "stream_id", HYP).items()}
    for k, words in group_rows(want).items():
        assert [w[5] for w in words if w[-1]] == whole[k][: sum(w[-1] for w in words)]


def group(df, key, columns):
    out = defaultdict(list)
    for r in df.orderBy(key, *columns[:2]).collect():
        out[r[key]].append(tuple(r[c] for c in columns))
    return out


def group_rows(table):
    out = defaultdict(list)
    for r in table:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


def test_silence_policies(run):
    got = run("s27_silence_policies").toPandas()
    kept = {p: set(map(tuple, g[["stream_id", "hyp_id", "pos", "agreed"]].values)) for p, g in got.groupby("policy")}
    assert kept["pad"] == kept["offset"] != kept["flush"] and not any(agreed for *_, agreed in kept["flush"])
    times = {p: dict(zip(zip(g.stream_id, g.hyp_id, g.pos), g.start)) for p, g in got.groupby("policy")}
    assert all(times["offset"][k] == pytest.approx(x + 6 * (k[1] - 1)) for k, x in times["pad"].items())


def silent(policy):
    m, out, by = M.Agreement(policy=policy), [], 0.0 if policy == "pad" else 6.0
    for row in [(1, 0, 0.0, 1.0, "a", 0.5), (1, 1, 1.0, 2.0, "b", 0.5), (1, 9, 2.0, 8.0, None, None), (2, 0, by, 1 + by, "a", 0.5), (2, 1, 1 + by, 2 + by, "b", 0.5)]:
        out += m.push(row)
    return [(r[4], r[6]) for r in out + m.close()]


def test_silence_moves_time_or_gives_up_what_is_pending():
    assert silent("pad") == silent("offset") == [("a", True), ("b", True)]
    assert silent("flush") == [("a", False), ("b", False)] * 2  # given up at the silence, said anew after it


def test_folds_equal_their_machines(run, t):
    calls = P._calls(t)
    policies = {"s13_breaker_keeps_failures": dict(failures=3, rest=86400.0), "s13_breaker_clears_failures": dict(failures=2, rest=86400.0, clear=True, trials=2)}
    for name, policy in policies.items():
        assert rows(run(name)) == by_machine(calls, "service", ["at", "id"], ["at", "ok"], lambda p=policy: M.Breaker(**p)), name
    assert rows(run("w15_exact_restarts")) == by_machine(calls, "service", ["at", "id"], ["at"], lambda: M.Restarts(3, 86400.0))
    tokens, names = P.timed(t), ["seq", "start", "end", "text"]
    assert rows(run("w7_lines")) == by_machine(tokens, "stream_id", ["seq"], [*names, "speaker"], M.Lines)
    assert rows(run("w16_sentences")) == by_machine(tokens, "stream_id", ["seq"], names, M.Sentences)


def test_streamed_breaker_equals_the_fold(run):
    assert rows(run("s13_streamed_breaker")) == rows(run("s13_breaker_keeps_failures"))


def test_streamed_voice_activity_equals_the_fold(run, t):
    frames = t.events.selectExpr("user_id AS stream_id", "event_id * 512 AS sample", "value / 50 AS prob")
    assert rows(run("s8_streamed_voice_activity")) == rows(D.voice_activity(frames, quiet=2048))


def test_voice_activity_alternates(run):
    for marks in group_rows(rows(run("s8_voice_activity"), "stream_id", "sample", "event")).values():
        # Padded ends may stand after the next start, so only their numbers are compared.
        assert sum(m[2] == "start" for m in marks) - sum(m[2] == "end" for m in marks) in (0, 1)


def test_monotonic(run, timed):
    want = []
    for k, tokens in timed.items():
        last = None
        for seq, start, end, _, _ in tokens:
            start = start - 0.4 if seq % 7 == 3 else start
            start = last + 0.01 if last is not None and start < last else start
            last = max(start, end)
            want.append((k, seq, start, last))
    assert rows(run("w9_monotonic")) == sorted(want, key=str)


def test_sentences_hold_every_word(run, timed):
    for k, got in group_rows(rows(run("w16_sentences"))).items():
        assert " ".join(r[4] for r in got) == " ".join(x[3] for x in timed[k])
        assert all(re.search("[.!?]$", r[4]) for r in got[:-1]) and [r[1] for r in got] == list(range(len(got)))


def test_truncated_words(run, timed):
    got = {(r[0], r[1]): r for r in rows(run("w19_truncate_words"))}
    for k, tokens in timed.items():
        mark = True
        for seq, start, end, text, _ in tokens:
            end = end + 2 if seq % 9 == 0 else end
            if end - start > 0.7 and text.strip() in (".", "!", "?"):
                end = start + 0.7
            elif end - start > 0.7 and mark:
                start = end - 0.7
            mark = text.strip() in (".", "!", "?")
            assert got[k, seq][2:4] == pytest.approx((start, end))


def test_blanks_and_silences(run, timed):
    found = group_rows(rows(run("w5_blank_to_silence")))
    for k, tokens in timed.items():
        want, open_ = [], None
        for seq, start, end, text, _ in tokens:
            if seq % 50 < 16:
                open_ = (seq, start, end) if open_ is None else (open_[0], min(open_[1], start), max(open_[2], end))
            else:
                want += [(k, *open_, "", -2)] if open_ and open_[2] - open_[1] >= 4 else []
                want, open_ = [*want, (k, seq, start, end, text, -1)], None
        want += [(k, *open_, "", -2)] if open_ and open_[2] - open_[1] >= 4 else []
        assert found.get(k, []) == want


def test_snapped_speakers(run, t):
    """By the rule itself: a change moves to the nearer mark, the earlier of two; a token has the last change up to it."""
    from loquent.plans.intervals_queries import segments, tokens

    for name, shift, least in (("j6_snap_speakers", 900, 0), ("j7_snap_speakers_first", 0, 1)):
        words, changes, want = group(tokens(t).filter(f"seq >= {least}"), "stream_id", ["seq", "start_ms", "text"]), group(segments(t), "stream_id", ["start_ms", "speaker"]), []
        for k, own in words.items():
            marks = [at for _, at, text in own if re.search("[.!?]$", text.strip(" "))]
            moved = []
            for at, speaker in changes[k]:
                at += shift
                before, after = max((m for m in marks if m <= at), default=None), min((m for m in marks if m >= at), default=None)
                near = at if before is None and after is None else after if before is None else before if after is None or at - before <= after - at else after
                moved.append((near, speaker))
            for seq, at, _ in own:
                last = [(m, s) for m, s in moved if m < at]
                want.append((k, seq, max(last)[1] if last else -1))
        assert rows(run(name), "stream_id", "seq", "speaker") == sorted(want, key=str), name


def test_cues_of_subtitles(run, timed):
    first = lambda kind, n: {r.stream_id: r.cue for r in run(f"b{n}_{kind}_cues").filter("number = 1").collect()}
    clock = lambda s, hours, mark: (f"{int(s // 3600):02d}:" if hours or s >= 3600 else "") + f"{int(s // 60) % 60:02d}:{int(s) % 60:02d}{mark}{round(s * 1000) % 1000:03d}"
    want = {}
    for k, tokens in timed.items():
        cue = [x for x in tokens if x[0] < 20 and x[4] == tokens[0][4]]
        want[k] = (min(x[1] for x in cue), max(x[2] for x in cue), " ".join(x[3] for x in cue).strip(" ").replace("-->", "->"))
    for k, (start, end, text) in want.items():
        assert first("txt", 2)[k] == text if k == min(want) else True
    texts, vtt, srt, tsv, js = (first(kind, n) for n, kind in enumerate(("txt", "vtt", "srt", "tsv", "json"), 2))
    for k, (start, end, text) in want.items():
        assert texts[k] == text
        assert vtt[k] == f"{clock(start, False, '.')} --> {clock(end, False, '.')}\n{text}\n"
        assert srt[k] == f"1\n{clock(start, True, ',')} --> {clock(end, True, ',')}\n{text}\n"
        assert tsv[k].split("\t") == [str(round(start * 1000)), str(round(end * 1000)), text]
        assert json.loads(js[k]) == {"id": 1, "start": start, "end": end, "text": text}


def test_cue_layout(run, timed):
    got = group_rows(rows(run("t19_cue_layout")))
    for k, tokens in timed.items():
        assert re.sub(r"\s+", " ", " ".join(c[4] for c in got[k])).strip() == re.sub(r"\s+", " ", " ".join(x[3] for x in tokens)).strip()
        assert [c[2:] for c in got[k]] == Q.wrap_cues([(x[1], x[2], " " + x[3]) for x in tokens])


def test_cues_wrap_and_pause():
    words = [(0.0, 1.0, " one"), (1.0, 2.0, " two"), (2.0, 3.0, " three"), (9.0, 9.5, " late")]
    assert Q.wrap_cues(words, width=9, lines=2) == [(0.0, 3.0, "one two\nthree"), (9.0, 9.5, "late")]


def test_signatures_and_compression(run, t):
    props = {r.event_id: r.props for r in t.events.collect()}
    assert {r.event_id: r.signature for r in run("t21_signature").collect()} == {k: hmac.new(b"key", p.encode(), hashlib.sha256).hexdigest() for k, p in props.items()}
    texts = {(r.conv_id, r.turn): r.text for r in t.conversations.collect()}
    assert {(r.conv_id, r.turn): r.ratio for r in run("t9_compression_ratio").collect()} == {k: len(x.encode()) / len(zlib.compress(x.encode())) for k, x in texts.items()}


def bare(text, form, keep=""):
    """Each character by its category, after the Unicode form."""
    return "".join(c if c in keep or unicodedata.category(c)[0] not in "MSP" else " " for c in unicodedata.normalize(form, text))


ODD = ["Café naïve—Œuvre №5 ﬁne", "Straße ½ + 3² = “x”", "a\u0301b e\u0308", "", "  plain  text ", "it's [laughs] (noise) ok", "日本語。テスト", "ÆØÅ łódź đak þing"]


def test_unicode_normalizers(run, t, spark):
    texts = {(r.conv_id, r.turn): r.text for r in t.conversations.collect()}
    assert {(r.conv_id, r.turn): r.text for r in run("t2_symbols").collect()} == {k: bare(x, "NFKC") for k, x in texts.items()}
    odd = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    assert [r.text for r in odd.orderBy("id").select(T.without_symbols("text").alias("text")).collect()] == [bare(x, "NFKC") for x in ODD]
    plain = [r.text for r in odd.orderBy("id").select(T.without_diacritics("text").alias("text")).collect()]
    assert plain[0] == "Cafe naive OEuvre No5 fine" and plain[1].startswith("Strasse 1 2   32   ") and plain[2] == "ab e" and plain[7] == "AEOA lodz dak thing"
    assert {(r.conv_id, r.turn) for r in run("t1_diacritics").collect()} == texts.keys()
    basic = {(r.conv_id, r.turn): r.text for r in run("t3_basic_normalizer").collect()}
    for k, x in texts.items():
        cut = re.sub(r"\(([^)]+?)\)", "", re.sub(r"[<\[][^>\]]*[>\]]", "", x.lower()))
        assert basic[k].split() == bare(cut, "NFKC").lower().split()


def test_english_normalizer(spark):
    cases = {
        "I won't go, it's Mr Smith's": "i will not go it is mister smith is", "um we've got twenty one dollars": "we have got $21", "three hundred and five": "305", "I'm gonna": "i am going to",
"minus two percent": "-2%", "nineteen ninety nine": "1999",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = [r.text for r in df.orderBy("id").select(T.english(df.text).alias("text")).collect()]
    assert got == list(cases.values())


@pytest.mark.parametrize(
    "words, digits",
    [("five twenty four", "524"), ("twenty nineteen", "2019"), ("two point five million", "2500000"), ("four point two billions", "4200000000s"), ("$20 million", "$20000000"), ("two double o eight", "2008"), ("one oh one", "101"), ("minus 500", "-500"), ("forty three thousand two hundred and sixty", "43260"),
     ("two dollars and seventy cents", "$2.70"), ("$0.36", "¢36"), ("three and a half million", "3500000"), ("b747", "b 747"), ("10 th", "10th"), ("twenty first", "21st"), ("nineteen sixties", "1960s"), ("thirty three hundred", "3300"), ("you and me", "you and me"), ("one two three", "123"), ("five per cent", "5%"), ("it is one", "it is one"),
     ("it was point two five percent", "it was .25%"), ("point five", ".5"), ("minus point five", "-.5"), ("minus double five", "-55"), ("minus minus three", "-3"), ("minus dollars", "-dollars"), ("minus you", "minus you"), ("and a half cup", "cup"), ("a cup and a half", "a cup and a half"), ("0 point five", ".5"), ("zero point zero five", "0.05"), ("5.0", "5"), ("made a point and left", "made a and left"),
     ("a point", "a point"), ("five point million", "5000000"), ("one hundred and double five", "10055"), ("two hundred and minus one", "200 -one"), ("four point two point six", "4.2.6"), ("$0 12", "¢12")],
)
def test_number_words(words, digits):
    assert number_words(words) == digits


def test_bounded_window(run, t):
    want = []
    for k, turns in group(t.conversations, "conv_id", ["turn", "text"]).items():
        sizes = [len(x) for _, x in turns]
        for i, (turn, _) in enumerate(turns):
            first = next(j for j in range(i + 1) if sum(sizes[j : i + 1]) <= 600 or j == i)
            want.append((k, turn, i + 1 - first, sum(sizes[:first])))
    assert rows(run("s6_bounded_window"), "conv_id", "turn", "kept", "removed") == sorted(want, key=str)


def fed(machine, rows):
    return [out for row in rows for out in machine.push(row)]


def test_buffer_is_cut_at_sentences():
    words = [(1, "token", 5.0, "One."), (1, "token", 9.0, "Two."), (1, "token", 14.0, "three"), (1, "upto", 16.0, "")]
    assert fed(M.Trim(15.0), words) == [(1, 9.0, 2, "sentence")]
    assert fed(M.Trim(15.0), words[:2] + [(1, "upto", 16.0, "")]) == [(1, 5.0, 1, "sentence")]
    assert fed(M.Trim(15.0), [(1, "token", 5.0, "One"), (1, "upto", 15.0, "")]) == []
    assert fed(M.Trim(15.0), [(1, "token", 5.0, "One"), (1, "upto", 15.5, "")]) == [(1, 5.0, 1, "committed")]


def test_buffer_is_cut_at_segments_in_the_middle_or_anew():
    words = [(1, "token", 8.0, "a"), (1, "token", 12.0, "b"), (1, "segment", 7.0, ""), (1, "segment", 11.0, ""), (1, "segment", 15.0, ""), (1, "upto", 16.0, "")]
    assert fed(M.Trim(15.0, "segment"), words) == [(1, 11.0, 1, "segment")]
    assert fed(M.Trim(15.0, "segment"), [(1, "upto", 10.0, "")]) == []
    late = M.Trim(15.0, "segment", output=10.0)
    assert fed(late, [(1, "upto", 16.0, "")]) == [(1, 8.0, 0, "half")]
    assert fed(M.Trim(15.0), [(1, "token", 1.0, "a"), (1, "upto", 2.0, ""), (2, "upto", 17.0, "")]) == [(2, 17.0, 1, "anew")]


def test_trimming_goes_on_and_forgets(run, timed):
    got = group_rows(rows(run("s3_buffer_trimming")))
    for k, cuts in got.items():
        assert [c[2] for c in cuts] == sorted(c[2] for c in cuts) and sum(c[3] for c in cuts) <= len(timed[k])
    assert got


@pytest.mark.parametrize("binding, keys", [("event.*", ["event.a"]), ("event.#", ["event", "event.a", "event.a.b"]), ("*.view.#", ["event.view", "event.view.x.y"]), ("#.b", ["b", "a.b", "a.a.b"]), ("event.*.b", ["event.a.b"])])
def test_topic_patterns(binding, keys):
    every = ["event", "event.a", "event.a.b", "event.view", "event.view.x.y", "b", "a.b", "a.a.b", "other"]

    def meets(words, pattern):
        if not pattern:
            return not words
        if pattern[0] == "#":
            return meets(words, pattern[1:]) or bool(words) and meets(words[1:], pattern)
        return bool(words) and pattern[0] in ("*", words[0]) and meets(words[1:], pattern[1:])

    want = [k for k in every if meets(k.split("."), binding.split("."))]
    assert [k for k in every if re.search(R.topic_pattern(binding), k)] == want and set(keys) <= set(want)


def test_lines_split_at_marks_only():
    words = [(0, 0.0, 1.0, "a", 1), (1, 1.0, 2.0, "b", 2), (2, 2.0, 3.0, ".", 2), (3, 3.0, 4.0, "c", 2), (4, 4.0, 9.0, "", -2), (5, 9.0, 10.0, "d", 2)]
    m = M.Lines()
    assert [(r[0], r[3], r[4]) for r in fed(m, words) + m.close()] == [(0, "a b .", 1), (1, "c", 2), (2, "", -2), (3, "d", 2)]


def test_merged_marks_keep_all_characters():
    rng = random.Random(2)
    for _ in range(300):
        words = rng.choices([" a", " b", ".", ",", " (", ")", ' "', "c"], k=rng.randrange(8))
        assert "".join(Q.merge_marks(words)) == "".join(words)
    assert Q.merge_marks([" (", " a", ")", "."]) == ["", " ( a).", "", ""]


def test_written_subtitles(run, timed):
    got = {r.stream_id: (r.lines, r.cues) for r in run("b7_written_subtitles").collect()}
    # Number, times, text and a blank line for each cue; a line break in a word is another line.
    assert got == {k: (sum(4 + x[3].strip(" ").count("\n") for x in tokens), len(tokens)) for k, tokens in timed.items()}


def test_wav_files(spark, tmp_path):
    import wave

    from loquent.sources.files import read_wav

    for name, channels, samples in (("a", 1, [0, 16384, -32768]), ("b", 2, [100, 300, -100, 100])):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(b"".join(x.to_bytes(2, "little", signed=True) for x in samples))
    got = {r.path[-5]: (r.rate, r.samples) for r in read_wav(spark, str(tmp_path)).collect()}
    assert got == {"a": (16_000, [0.0, 0.5, -1.0]), "b": (16_000, [pytest.approx(200 / 32768), 0.0])}


def lines_of(tokens, attributed):
    """By places in the list: a change of speaker counts one place after a mark, or with silence."""
    lines, waiting, owner, known, mark = [], [], -1, 0.0, None
    for i, (_, start, end, text, speaker, horizon) in enumerate(tokens):
        if not attributed and speaker == -1:
            speaker = 1
        if attributed and tokens[-1][4] != -2:
            if speaker in (-1, 0) and end >= horizon:
                waiting.append((start, end, text))
                continue
            speaker = owner if speaker in (-1, 0) else speaker
            known = max(end, known) if speaker not in (-1, 0) else known
        if not lines:
            lines.append([start, end, text, speaker, round(end - known, 2)])
            continue
        owner = lines[-1][3]
        mark = i if text in (".", "!", "?") else mark
        if speaker != owner and (mark == i - 1 or -2 in (speaker, owner)):
            lines.append([start, end, text, speaker, round(end - known, 2)])
        elif text:
            lines[-1] = [lines[-1][0], end, lines[-1][2] + " " + text, lines[-1][3], round(end - known, 2)]
    out = [(n, *line) for n, line in enumerate(lines)]
    return out + ([(-1, waiting[0][0], waiting[-1][1], " ".join(w[2] for w in waiting), -1, 0.0)] if waiting else [])


def test_speaker_lines(run, t):
    streams = group(R.attributed(t), "stream_id", ["seq", "start", "end", "text", "speaker", "horizon"])
    for name, attributed in (("w7_speaker_lines", True), ("w7_lines_without_speakers", False)):
        want = [(k, *line) for k, tokens in streams.items() for line in lines_of(tokens, attributed)]
        assert rows(run(name)) == sorted(want, key=str), name
    assert len(want) > len(streams)
    silent = [(0, 0.0, 1.0, "a", 1, 0.0), (1, 1.0, 2.0, "b", -1, 0.0), (2, 2.0, 9.0, "", -2, 0.0)]
    m = M.SpeakerLines()
    assert fed(m, [(*x[1:], -2) for x in silent]) + m.close() == lines_of(silent, True) == [(0, 0.0, 2.0, "a b", 1, 2.0), (1, 2.0, 9.0, "", -2, 9.0)]
