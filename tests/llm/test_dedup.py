"""Substring, line and near deduplication, decontamination and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quernix.llm import decontaminate, lines, queries, simhash, substring
from tests.conftest import SF
from tests.llm.test_formats import ODD, WORDS, odd, rows, sha


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def brute_substring(pairs, k=20):
    """pairs: (doc_id, text); ids may repeat."""
    words = [WORDS.findall(t or "") for _, t in pairs]
    first = {}
    for (d, _), w in zip(pairs, words):
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            at = ((d is not None, d or 0), i)
            first[x] = min(first.get(x, at), at)
    out = []
    for (d, _), w in zip(pairs, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < ((d is not None, d or 0), i):
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def substring_digest(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], sha(r["text"])) for r in rows(substring.dedup_substrings(df)))


def test_substring_brute(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    make = lambda n: " ".join(rnd.choices(vocab, k=n))
    shared = [make(60) for _ in range(5)]
    texts = [make(rnd.randrange(0, 120)) + " " + rnd.choice(shared)[rnd.randrange(50) :] + "\n" + make(30) for _ in range(150)] + ["x y " * 300] * 3 + [shared[0]] * 40
    assert substring_digest(docs(spark, texts)) == brute_substring(list(enumerate(texts)))


def test_substring_hot_passages(spark, monkeypatch):
    """One passage in most documents, over many small steps, lanes and partitions; ids that repeat tie."""
    rnd = random.Random(7)
    make = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    hot = make(70)
    pairs = [(i if i % 11 else i // 2, make(rnd.randrange(0, 30)) + " " + hot[rnd.choice((0, 0, 40)) :] + " " + make(rnd.randrange(0, 25))) for i in range(300)] + [(None, hot), (5, hot), (5, hot + " x")]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(16)
    hots = []
    monkeypatch.setattr(substring, "cut", lambda x, f=substring.cut: hots.append(x.columns) or f(x))
    assert substring_digest(df) == brute_substring(pairs)
    assert ["did", "rk", "lo", "hi", "bucket", "blob"] in hots  # the lanes were used


def test_thin_keeps_the_earliest():
    """Equal pieces of a lane: the earliest and its ties stay, all others are ranges; nothing is lost."""
    import numpy as np

    rnd = random.Random(3)
    pieces = [b"a b c", b"d e", b"f"]
    rows = [(rnd.randrange(-3, 4), rnd.randrange(3), rnd.randrange(2), rnd.choice(pieces)) for _ in range(200)]
    thin, gone = substring._Thin(), []
    for i in range(0, 200, 20):
        part = rows[i : i + 20]
        cols = [np.array([f(r) for r in part], np.int64) for f in (lambda r: r[0], lambda r: r[2], lambda r: r[1], lambda r: len(r[3].split()))]
        gone += [tuple(x.values())[:4] for x in thin.add(substring._pack(cols, b" ".join(r[3] for r in part))).to_pylist()]
    (did, rk, pos, words), text = substring._unpack(thin.blob(), 4)
    left = Counter()
    at, all_words = 0, text.split()
    for d, r, q, n in zip(did.tolist(), rk.tolist(), pos.tolist(), words.tolist()):
        left[(d, q, r, b" ".join(all_words[at : at + n]))] += 1
        at += n
    first = {p: min((d, q) for d, q, _, x in rows if x == p) for p in pieces}
    assert set(left) == {(d, q, r, p) for d, q, r, p in rows if (d, q) == first[p]} and max(left.values()) == 1
    assert set(gone) == {(d, r, q, q + len(p.split())) for d, q, r, p in rows if (d, q) > first[p]}


def test_substring_odd(spark):
    assert substring_digest(odd(spark)) == brute_substring([(r[0], r[1]) for r in ODD])
    assert substring.dedup_substrings(odd(spark).limit(0)).count() == 0


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute_lines(pairs, tau=2, low=30):
    """(doc_id, kept text, n_lines, n_removed, n_near, n_links) of each (doc_id, text); lines under low allow no edits."""
    at = defaultdict(list)
    for d, t in pairs:
        for i, x in enumerate(t.split("\n") if t is not None else []):
            if x.strip(" \t\n\x0b\x0c\r"):
                at[x].append(((d is not None, d or 0), i))
    first = {x: min(v) for x, v in at.items()}
    links = defaultdict(set)
    for x in first:
        for y in first:
            if x != y and min(len(x), len(y)) >= low and abs(len(x) - len(y)) <= tau and edits(x, y) <= tau:
                links[x].add(y)
    near = {x for x in first if any(first[y] < first[x] for y in links[x])}
    out = []
    for d, t in pairs:
        all_lines = t.split("\n") if t is not None else []
        equal = [x in first and first[x] < ((d is not None, d or 0), i) for i, x in enumerate(all_lines)]
        keep = [x for x, e in zip(all_lines, equal) if not e and x not in near]
        close = sum(x in near and not e for x, e in zip(all_lines, equal))
        out.append((d, None if t is None else "\n".join(keep), len(all_lines), len(all_lines) - len(keep), close, sum(len(links[x]) for x in all_lines)))
    return Counter(out)


def line_rows(df):
    return Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["n_near"], r["n_links"]) for r in rows(lines.dedup_lines(df, counts=True)))


def mutate(rnd, s, n):
    for _ in range(n):
        i, op = rnd.randrange(len(s) + 1), rnd.randrange(3)
        s = s[:i] + (rnd.choice("abcé漢 ") if op else "") + s[i + (op != 1) :]
    return s


def test_lines_brute(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choices("abcdefghij klmnop", k=rnd.choice([29, 30, 31, 32, 33, 40, 41, 64, 90]))) for _ in range(25)]
    pool = base + [mutate(rnd, rnd.choice(base), rnd.randrange(1, 5)) for _ in range(120)]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randrange(1, 6)) + rnd.choices(["short", ""], k=1)) for _ in range(60)]
    want = brute_lines(list(enumerate(texts)))
    assert line_rows(docs(spark, texts)) == want and sum(x[4] for x in want) > 20
    assert Counter((r["doc_id"], r["text"]) for r in rows(lines.dedup_lines(docs(spark, texts)))) == Counter(x[:2] for x in want.elements())


def test_op3_query(spark, tmp_path):
    """All columns of the query; equal short lines go but the first; blank lines stay."""
    base = "a long line that stays where it is, number one"
    texts = [f"Home\n\n{base}\nMenu 12\nHome", "Menu 12\n \nhome\n \n", None, "Home\nMenu 13", "", base.replace("stays", "stayed") + "\n" + base[:-3] + "\n" + base]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_lines(list(enumerate(texts)))
    assert {x[0]: x[1] for x in want} == {0: f"Home\n\n{base}\nMenu 12", 1: " \nhome\n \n", 2: None, 3: "Menu 13", 4: "", 5: base[:-3]}
    got = rows(queries.op3_line_dedup(spark, str(tmp_path)))
    names = ("doc_id", "kept_sha256", "n_kept_chars", "n_lines", "n_removed", "n_near", "n_links")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter((x[0], sha(x[1] or ""), len(x[1] or ""), *x[2:]) for x in want.elements())


def test_lines_odd(spark):
    df = odd(spark)
    assert lines.dedup_lines(df).columns == df.columns
    assert line_rows(df) == brute_lines([(r[0], r[1]) for r in ODD])
    assert lines.dedup_lines(df.limit(0), counts=True).count() == 0


def test_verified_is_within(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choices("ab cde", k=n)) for n in (0, 1, 2, 5, 23, 24, 25, 60, 129)]
    pairs = [(x, mutate(rnd, x, n)) for x in base for n in (0, 1, 2, 2, 3, 4)] + [(x, y) for x in base for y in base] + [("x" * 70, "x" * 68), ("aé" * 40, "é" + "aé" * 40)]
    d = spark.createDataFrame(pairs, "a string, b string")
    got = [(r["a"], r["b"], r["v"], r["w"]) for r in rows(d.select("a", "b", lines.verified(F.col("a"), F.col("b")).alias("v"), lines.within(F.col("a"), F.col("b")).alias("w")))]
    for a, b, v, w in got:
        n = edits(a, b)
        assert v == w == (n if n <= 2 else None), (a, b)


@pytest.mark.parametrize("a, b", [("", ""), ("abc", ""), ("kitten", "kittens"), ("kitten", "sitting"), ("abcdef", "bcdefa"), ("🙂é漢", "🙂e漢"), ("xabcdefg", "abcdefgy"), ("ab", "ba")])
def test_within(spark, a, b):
    d = spark.createDataFrame([(a, b)], "a string, b string").select(lines.within(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert d == (edits(a, b) if edits(a, b) <= 2 else None)


def brute_fp(text):
    from xxhash import xxh64_intdigest

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    fps = [brute_fp(t) for _, t in pairs]
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(pairs))


def digest(df):
    nd = simhash.near_duplicates(df)
    return Counter((r["did"] if r["did"] != simhash.NULL_ID else None, f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in rows(nd))


def test_simhash_brute(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(80)]
    base = [rnd.choices(vocab, k=rnd.randrange(3, 90)) for _ in range(25)]
    texts = []
    for _ in range(140):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab).upper()
        texts.append(" ".join(w))
    texts += ["", "One", "one", "a b c d"]
    assert digest(docs(spark, texts)) == brute_components(list(enumerate(texts)))
    assert digest(odd(spark)) == brute_components([(r[0], r[1]) for r in ODD])
    kept = rows(simhash.drop_near_duplicates(docs(spark, texts)))
    assert {r["doc_id"] for r in kept} == {c for *_, c in brute_components(list(enumerate(texts)))}
    e = odd(spark).limit(0)
    assert simhash.near_duplicates(e).count() == 0 and simhash.drop_near_duplicates(e).columns == e.columns


def test_near_copies_of_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    make = lambda k: " ".join(f"{k}{rnd.randrange(10**6)}" for _ in range(40))
    alone = [(None, make("a")), (None, make("b")), (None, make("c")), (7, make("d")), (7, make("e")), (None, ""), (8, make("f"))]
    copies = [(8, alone[0][1]), (None, alone[3][1]), (9, alone[4][1]), (8, alone[6][1])]
    df = spark.createDataFrame(alone + copies, "doc_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in rows(simhash.drop_near_duplicates(df)))
    # One row of each text; a real id goes before a null one.
    assert kept == Counter([copies[0], *alone[1:]])


def test_links_at_the_limit(spark):
    rnd = random.Random(1)
    fps = []
    for _ in range(40):
        a = rnd.getrandbits(64)
        fps.append(a)
        for n in (1, 2, 3, 4, 4, 4, 5):
            b = a
            for bit in rnd.sample(range(64), n):
                b ^= 1 << bit
            fps.append(b)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    got = Counter((r["a"], r["b"]) for r in rows(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))))
    want = Counter((a, b) for a in fps for b in fps if a < b and bin((a ^ b) % 2**64).count("1") <= 4)
    assert got == want


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in rows(simhash.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


ITEMS = [
    (1, "A farmer named Tom sold 12 apples for 3 dollars each on the market day. How much money did Tom receive in total for the apples?"),
    (2, "The capital of the northern province lies beside a wide river that freezes every winter."),
    (3, "tiny item"),
    (4, None),
    (1, "A farmer named Tom sold 12 apples for 3 dollars each on the market day. How much money did Tom receive in total for the apples?"),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("w", F.lit(1))
    q = ITEMS[0][1]
    texts = [
        "Some words before. " + q + " And after.",
        "Intro here. " + q.replace("Tom", "Ann").replace("12", "40").replace("3", "7") + " The end.",
        "Intro here. " + q.replace("12", "40").replace("named Tom", "named Ann"),  # Tom is both Ann and Tom: not one template
        "nothing of the kind is written in this text about farms and markets",
        None,
        "",
        "THE CAPITAL OF THE NORTHERN PROVINCE LIES BESIDE A WIDE RIVER, THAT FREEZES EVERY WINTER",
        "I saw a tiny item there",
    ]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in rows(decontaminate.contaminated(docs(spark, texts), bench))}
    assert got[(0, 1)] is True and got[(1, 1)] is False and (2, 1) not in got
    assert {d for d, _ in got} & {3, 4, 5} == set()
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert {r["doc_id"] for r in rows(left)} >= {2, 3, 4, 5} and {r["doc_id"] for r in rows(left)}.isdisjoint({0, 1})
    e = docs(spark, ["x"]).limit(0)
    assert decontaminate.contaminated(e, bench).count() == 0 and decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd(spark), bench).count() == len(ODD)


def found(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["verbatim"], r["n_matched"], r["n_windows"]) for r in rows(decontaminate.contaminated(docs(spark, texts), bench))}


def test_decontamination_literal_windows(spark):
    """Items of mostly numbers or names, and copies in other case, match word for word."""
    items = ["What is 12 + 35 * 4 - 7 ?", ITEMS[1][1], "Ann Lee, Bob Ray, Cy Dow, Dee Fox and Eve Hill met in Rome.", "12 + 35 = 47"]
    texts = ["Sums. What is 12 + 35 * 4 - 7 ? Try it.", "HEAD " + items[1].upper(), "Read: " + items[1].title(), "So " + items[2].lower(), "What is 13 + 35 * 4 - 7 ?", "note 12 + 35 = 47"]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 2)} and all(v for v, *_ in got.values())
    assert got[(0, 0)][1:] == (1, 1) and got[(1, 1)][1:] == (8, 8)


def test_decontamination_openers(spark):
    """Names that open a sentence, and items after a heading, a mark or a line without a stop."""
    tom = "Tom has 5 apples. Tom gives 2 apples away. Tom eats 1 apple. How many remain?"
    items = [tom, "What is the capital of France?", "Photosynthesis turns light into sugar inside leaves."]
    bob = tom.replace("Tom", "Bob").replace("5", "9").replace("2", "4").replace("1", "3")
    texts = [bob, "Question 4\n" + items[1], "Q: " + items[1], "Q: " + bob, "Fact " + items[2], bob.replace("Bob eats", "Al eats"), "Tom has gone home. How many remain?"]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 0), (4, 2)}
    assert not got[(0, 0)][0] and not got[(3, 0)][0] and got[(1, 1)][0] and got[(2, 1)][0] and got[(4, 2)][0]


def test_decontamination_slots_are_one_to_one(spark):
    """One value stands for one value in both directions; a number in words is a number; verbatim is the whole item."""
    item = "Tom gave 12 of his red apples to Mary and then Tom ate 5 apples while Mary sold the other apples in town."
    items = [item, "a plain sentence about the long river that runs past the old mill and into the sea"]
    texts = [
        "So, " + item.replace("Tom", "Ann").replace("Mary", "Ann"),
        "So, " + item.replace("Tom", "Bob").replace("Mary", "Sue"),
        "So, " + item.replace("12", "thirty-five"),
        "So, " + item.replace("Tom", "Bob", 1),
        "So, " + item.upper(),
        items[1] + " again",
        items[1].replace("old mill", "new mill"),
        # The same template under another text's number: a unit needs a number of its own text.
        "12",
        "apples to Mary and then",
    ]
    got = found(spark, texts, items)
    # The fourth keeps more than half of the item as it is; the seventh less.
    assert {k: v[0] for k, v in got.items()} == {(1, 0): False, (2, 0): False, (3, 0): False, (4, 0): True, (5, 1): True}


def brute_tokens(text):
    """Kind and literal word of each token; kinds: w, N, U, A (a name), O (a capital that opens a sentence or line)."""
    strip = lambda w: w.strip(decontaminate._EDGE)
    out = []
    for line in text.splitlines():
        opens, fresh_number = True, False
        for w in line.split():
            core = strip(w)
            low = core.lower()
            if core:
                number = decontaminate.is_number(low)
                if number:
                    kind = "N"
                elif low in decontaminate._UNITS and out and out[-1][0] == "N":
                    kind = "U"
                elif core[0].isupper() and low not in decontaminate._PLAIN:
                    kind = "O" if opens else "A"
                else:
                    kind = "w"
                out.append((kind, low))
            opens = w.rstrip(decontaminate._CLOSERS)[-1:] in (".", "!", "?") and w.rstrip(decontaminate._CLOSERS) != ""
    return out


def test_templates_against_brute(spark):
    """Template and literal form of every text of a step, read together and alone."""
    texts = [r["text"] or "" for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))] + [i[1] or "" for i in ITEMS] + ["", "12 km\nkm 5. (5) \"Ann.\" said Bob\n\n... Tom's thirty-five £3 apples", "7", "km"]
    t = decontaminate.Templates(texts)
    by = defaultdict(list)
    for i, d in enumerate(t.doc.tolist()):
        kind, named = chr(t.kinds[i] or 119), chr(t.named[i] or 119)
        by[d].append(("O" if named != kind else kind, t.words[t.at[i]].strip(decontaminate._EDGE).lower(), int(t.pos[i])))
    for d, text in enumerate(texts):
        want = brute_tokens(text)
        assert [(k, w) for k, w, _ in by[d]] == want and [p for *_, p in by[d]] == list(range(len(want))), text[:80]


def test_decontamination_finds_the_planted(spark):
    """Against a brute-force search for runs of eight words that a document shares with an item."""
    norm = lambda t: [w.strip(".,!?;:\"'()").lower() for w in (t or "").split()]
    items = [(r["item_id"], norm(r["text"])) for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    ds = {r["doc_id"]: norm(r["text"]) for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    want = set()
    for d, w in ds.items():
        text = " " + " ".join(w) + " "
        for i, x in items:
            n = sum(f" {' '.join(x[j : j + 8])} " in text for j in range(max(1, len(x) - 7)))
            if n >= 0.7 * max(1, len(x) - 7):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in rows(queries.op7_decontamination(spark, SF))}
    assert want and want <= got and len(got) <= len(want) + 3


def test_op2_sf(spark):
    src = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op2_substring_dedup(spark, SF)))
    assert got == brute_substring(src)


def test_op4_sf(spark):
    src = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))]
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(queries.op4_simhash(spark, SF))) == brute_components(src)


def test_pipeline(spark):
    """Each stage against the brute-force version of its own step, on its own input."""
    import corpus_pipeline as cp
    from quernix.llm import language

    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(d)
    ok = lambda t: t is not None and language.has_letter(t) and model.predict(t.encode())[1] >= model.threshold
    kept = [(r["doc_id"], r["text"]) for r in rows(d) if ok(r["text"])]
    first = cp.keep_known_language(spark, d, SF).cache()
    assert Counter((r["doc_id"], r["text"]) for r in rows(first)) == Counter(kept) and first.columns == d.columns and first.schema == d.schema
    short = first.where("length(text) < 3000").limit(60).cache()
    second = cp.drop_repeated_lines(spark, short, SF)
    assert Counter((r["doc_id"], r["text"]) for r in rows(second)) == Counter(x[:2] for x in brute_lines([(r["doc_id"], r["text"]) for r in rows(short)]).elements())
    assert all(r["n_chars"] == len(r["text"]) for r in rows(second)) and second.columns == d.columns
    third = cp.keep_one_of_near_copies(spark, first, SF)
    assert {r["doc_id"] for r in rows(third)} == {c for *_, c in brute_components(kept)} and third.columns == d.columns
    fourth = cp.drop_benchmark_leaks(spark, first, SF)
    leaks = {r["doc_id"] for r in rows(queries.op7_decontamination(spark, SF))}
    assert {r["doc_id"] for r in rows(fourth)} == {i for i, _ in kept} - leaks and fourth.columns == d.columns
    out = rows(cp.run(spark, SF))
    assert out and {r["doc_id"] for r in out} <= {i for i, _ in kept} - leaks
    assert [n for n, _ in cp.STAGES] and cp.ORACLE_SQL is None


def test_pipeline_odd_input(spark):
    """Nulls in any column, repeated rows, empty and very long texts, clashing names and an empty table, in every stage."""
    import corpus_pipeline as cp

    d = odd(spark)
    for name, stage in cp.STAGES:
        out = rows(stage(spark, d, SF))
        if name == "language_id":
            assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in out)
        if name == "line_dedup":
            assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(x[:2] for x in brute_lines([(r[0], r[1]) for r in ODD]).elements())
        if name == "simhash_dedup":
            assert {(r["doc_id"], r["text"]) for r in out} == ({(r[0], r[1]) for r in ODD} | {(1, None)}) - {(2, "")} and len(out) == len(ODD) - 2
        if name == "decontamination":
            assert len(out) == len(ODD)
        if name == "packing":
            assert sum(r["length"] for r in out if r["start"] == 0) and {r["doc_id"] for r in out} == {r[0] for r in ODD}
        else:
            assert stage(spark, d, SF).columns == d.columns
        assert stage(spark, d.limit(0), SF).count() == 0, name


def test_pipeline_deletes_what_it_wrote(spark):
    import os

    import corpus_pipeline as cp
    from quernix.llm import common

    at = common.checkpoint_root(spark).removeprefix("file:")
    held = common.cut(spark.range(3))
    before = set(os.listdir(at))
    cp.run(spark, SF).count()
    assert len(set(os.listdir(at)) - before) <= 1 and held.count() == 3  # the last stage still reads its input


def test_no_local_checkpoint():
    import pathlib

    import quernix.llm

    for p in pathlib.Path(quernix.llm.__file__).parent.glob("*.py"):
        assert "localCheckpoint(" not in p.read_text()
