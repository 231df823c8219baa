import random
import re

from facetta.llm import chat

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")


def norm(x):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")


def plain(rows):
    """{(conv, turn): (text, reply_to, root, passages, linked)} message by message."""
    own, said = {}, {}
    for c, t, _, text in rows:
        lines = [x for x in (text or "").split("\n") if not MARKS.match(x)]
        own[(c, t, text)] = "\n".join(lines).strip(" \t\n\x0b\f\r") if any(MARKS.match(x) for x in (text or "").split("\n")) else text or ""
    for c, t, _, text in rows:
        if c is not None and t is not None:
            o = own[(c, t, text)]
            for u in {o, *re.split(r"\n[ \t]*\n", o), *o.split("\n")}:
                if norm(u):
                    said.setdefault((c, norm(u)), []).append(t)
    links, counts = {}, {}
    for c, t, text in {(c, t, x) for c, t, _, x in rows}:
        runs, last = [], None
        for line in (text or "").split("\n"):
            m = MARKS.match(line)
            level = m[1].count(">") if m else 0
            if level and level == last:
                runs[-1][1].append(line[m.end() :])
            elif level:
                runs.append((level, [line[m.end() :]]))
            last = level
        for level, lines in runs:
            key = norm("\n".join(lines))
            if key and c is not None and t is not None:
                first = min(said.get((c, key), [t]))
                n = counts.setdefault((c, t), [0, 0])
                n[0] += 1
                if first < t:
                    n[1] += 1
                    links.setdefault((c, t), {}).setdefault(level, []).append(first)
    reply = {k: max(v[min(v)]) for k, v in links.items()}
    out = []
    for c, t, _, text in rows:
        root = t
        while (c, root) in reply:
            root = reply[(c, root)]
        out.append((c, t, own[(c, t, text)], reply.get((c, t)), root, *counts.get((c, t), (0, 0))))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id long, turn long, role string, text string, root int, key string")
    return sorted(((r.conv_id, r.turn, r.text, r.reply_to, r.root, r.n_passages, r.n_linked) for r in chat.linked_conversations(frame).collect()), key=str)


THREAD = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> hello   THERE.\nFine."),
    (1, 2, "user", ">> Hello there.\n> Fine.\n\nGood!"),
    (1, 3, "user", "> Never said\nWhat?"),
    (1, 4, "assistant", "> Hello there.\n> How are you?\nTwo lines\n> Good!\nend"),
    (1, 5, None, None), (1, 6, "user", ""), (1, 7, "user", "> > > deep\n"), (1, 8, "user", ">"), (1, 8, "user", ">"), (None, 9, "user", "> Fine."), (2, None, "user", "> Fine."), (2, 1, "user", "> Fine.\nx"),
    (3, 1, "user", "> later\nearly"), (3, 2, "user", "later"), (1, 9, "user", "a\n\nb c\n\nd"), (1, 10, "user", "> B  c"),
]


def test_thread(spark):
    got = run(spark, THREAD)
    assert got == plain(THREAD)
    by = {(r[0], r[1]): r for r in got if r[0] == 1 and r[1] < 5}
    assert [by[(1, t)][3] for t in range(5)] == [None, 0, 1, None, 2] and by[(1, 4)][4] == 0 and by[(1, 4)][2] == "Two lines\nend"


def test_trimmed_quotes_link(spark):
    """Several but not all lines or paragraphs of a message, and lines that no message has together."""
    rows = [
        (1, 0, "user", "one a\none b\n\ntwo\n\nthree a\nthree b"), (1, 1, "user", "l1\nl2\nl3\nl4"), (1, 2, "user", "l2\nx"),
        (1, 3, "user", "> two\n>\n> Three a\n> three b\nok"), (1, 4, "user", "> one a one b\n>\n> two\nok"), (1, 5, "user", "> l2\n> l3\nok"), (1, 6, "user", "> l1\n> l4\nok"),
        (1, 7, "user", "> l3\n> l1\nok"), (1, 8, "user", "> l3\n> l3\nok"), (1, 9, "user", "> l1\n> x\nok"), (1, 10, "user", "> l4\n> later\nok"), (1, 11, "user", "a\nl4\nlater"),
        (2, 1, "user", "> l2\n> l3\nok"), (None, 4, "user", "> l2\n> l3"), (1, 12, "user", "> one a one b\n>\n> three a three b\nok"), (1, 13, "user", "> l2\n> x\n> y\nok"),
    ]
    got = {(r[0], r[1]): r[3:] for r in run(spark, rows)}
    links = {k: v[0] for k, v in got.items()}
    assert [links[(1, t)] for t in range(3, 14)] == [0, 0, 1, 1, None, None, None, None, None, 0, None]
    assert links[(2, 1)] is None and links[(None, 4)] is None
    assert got[(1, 5)] == (1, 1, 1, 1) and got[(1, 7)] == (None, 7, 1, 0)


def test_random_threads(spark):
    r = random.Random(4)
    rows = []
    for c in range(12):
        said = []
        for t in range(40 if c else 400):
            text = " ".join(r.choice("yes no maybe so then now".split()) for _ in range(r.randint(1, 3)))
            for _ in range(r.choice((0, 0, 1, 2))):
                if said:
                    text = "\n".join(r.choice(("> ", ">", ">> ")) + x for x in r.choice(said).split("\n")) + "\n" + text
            said.append(text)
            rows.append((c, t, "user", text))
    assert run(spark, rows) == plain(rows)


def test_conversations_are_rows(spark):
    frame = spark.createDataFrame([(*r, 0) for r in THREAD], "conv_id long, turn long, role string, text string, root int")
    rows = chat.conversations(frame, span=4).collect()
    want = {}
    for c, t, text, reply, root, _, _ in plain(THREAD):
        want.setdefault((c, root, None if t is None else t // 4), []).append((t, reply, text))
    got = {(r.conv_id, r.root, r.part): [(m.turn, m.reply_to, m.text) for m in r.messages] for r in rows}
    assert {k: sorted(v, key=str) for k, v in want.items()} == {k: sorted(v, key=str) for k, v in got.items()}
    for r in rows:
        assert [m.turn for m in r.messages] == sorted(m.turn for m in r.messages if m.turn is not None) or r.part is None
        assert r.n == len(r.messages) and r.rendered.count("<|end|>") == r.n
    assert chat.conversations(frame.limit(0)).collect() == []


def test_very_long_texts(spark):
    long = "\n".join(f"line {i} of a very long message" for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> " + long.replace("\n", "\n> ") + "\nyes"), (1, 2, "user", "> line 19999 of a very long message\nno")]
    assert run(spark, rows) == plain(rows) and [r[3] for r in run(spark, rows)] == [None, 0, 0]


def test_empty_and_real(spark, sf):
    assert run(spark, []) == []
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = chat.linked_conversations(table)
    assert got.count() == table.count() and got.filter("text is null or root <> turn").count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = chat.linked_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
