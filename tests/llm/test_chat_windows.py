import hashlib
import random
import re
from math import ceil

from pyspark.sql import functions as F

from wattspark.llm import chat_windows as c


def conversations():
    r = random.Random(6)
    nasty = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "\\", "<\\s>", "<</\\\\s>", "[\\INST]", "<", "[", "é", " ", "\n", "word "]
    text = lambda n: "".join(r.choice(nasty) for _ in range(r.randint(0, n)))
    rows = []
    for k in range(40):
        t = 0
        if r.random() < 0.5:
            rows.append((k, t, "system", text(30)))
            t += 1
        for _ in range(r.randint(0, 25)):
            rows.append((k, t, r.choice(["user", "assistant", "tool use\n<s>"]), text(120)))
            t += r.randint(0, 2)
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} " + "x" * (t % 90)) for t in range(3000)]  # a hot conversation
    rows += [(101, 0, "system", "only")]
    rows += [(102, None, None, None), (102, 1, "assistant", None), (102, 1, "assistant", None), (102, 1, "user", "tie")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rows += [(103, 0, "user", "long " * 20000), (103, 1, "assistant", "</s>" * 5000), (103, 2, "user", "")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "w") for x in rows], "conv_id long, turn long, role string, text string, window string")


def plain_windows(rows, budget=256, history=64):
    """Windows by the definition, one conversation after another."""
    groups = {}
    for k, t, role, text in rows:
        groups.setdefault(k, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for k, turns in groups.items():
        turns.sort()
        turns = [(role, text, ceil(len(text) / 4) + 4) for _, _, role, text in turns]
        system = turns[0] if turns[0][0] == "system" else None
        body = turns[1:] if system else turns
        half = max((budget - history - (system[2] if system else 0)) // 2, 1)
        at, windows = 0, {}
        for i, x in enumerate(body):
            windows.setdefault(2 * (at // half) + (x[2] > half), []).append((i, at))
            at += x[2]
        starts = [0]
        for x in body:
            starts.append(starts[-1] + x[2])
        made = []
        for w, own in sorted(windows.items()) or [(0, [])]:
            first = not made
            old = [i for i in range(len(body)) if own and own[0][1] - history <= starts[i] < own[0][1]]
            made.append((w, ([(*system, first)] if system else []) + [(*body[i], False) for i in old] + [(*body[i], True) for i, _ in own]))
        out[k] = made
    return out


def test_windows_against_plain_definition(spark):
    rows = conversations()
    made = c.format_windows(frame(spark, rows), budget=256, history=64)
    got = {}
    for r in made.collect():
        got.setdefault(r.conv_id, []).append(r)
    want = plain_windows(rows)
    assert got.keys() == want.keys()
    for k, windows in want.items():
        own = sorted(got[k], key=lambda r: r.window)
        assert [r.window for r in own] == [w for w, _ in windows]
        for r, (_, turns) in zip(own, windows):
            assert list(r.fresh) == [x[3] for x in turns]
            assert r.n_tokens == sum(x[2] for x in turns)
            parts = re.findall(r"<s>(.*?)</s>", r.formatted, re.S)
            assert "".join(f"<s>{p}</s>" for p in parts) == r.formatted
            assert [re.sub(r"(<<?/?|\[/?)\\(\\*)(s>|INST\]|SYS>>|\|)", r"\1\2\3", p.split("\n", 1)[1]) for p in parts] == [x[1] for x in turns]
            masked = [re.sub(r"(<<?/?|\[/?)\\(\\*)(s>|INST\]|SYS>>|\|)", r"\1\2\3", r.formatted[s.start : s.end]) for s in r.loss]
            assert masked == [x[1] for x in turns if x[3] and x[0] == "assistant"]
            new = [x[2] for x in turns if x[3] and x[0] != "system"]
            assert len(new) == 1 or r.n_tokens <= 256 or turns[0][0] == "system" and turns[0][2] > 100


def test_digests(spark):
    rows = conversations()
    got = {r.conv_id: r for r in c.conversation_digests(c.format_windows(frame(spark, rows))).collect()}
    groups = {}
    for k, t, role, text in rows:
        groups.setdefault(k, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for k, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        targets = "".join(text for _, _, role, text in turns if role == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(targets), hashlib.sha256(targets.encode()).hexdigest())
        assert got[k].formatted_chars >= len(said)


def test_no_history_and_empty(spark):
    df = frame(spark, conversations())
    made = c.format_windows(df, budget=128, history=0)
    assert made.where(F.exists("fresh", lambda x: ~x)).where(~F.startswith("formatted", F.lit("<s>system"))).count() == 0
    assert c.conversation_digests(c.format_windows(df.limit(0))).count() == 0


def test_native_plan(spark):
    plan = c.conversation_digests(c.format_windows(frame(spark, conversations())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
