"""Chat collapse, url reputation, personal data and mixing, on edge cases and
against plain Python."""

import hashlib
import math
import re
from collections import Counter

from ratewise.llm import chat, mixing, pii, url_reputation

TURNS = "conv_id long, turn long, role string, text string"


def convs(spark, rows):
    return chat.collapse_and_render(spark.createDataFrame(rows, TURNS)).collect()


def test_chat_keeps_maximal_conversations(spark):
    a, b, c = (0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "bye")
    rows = [(1, *a), (2, *a), (2, *b), (3, *a), (3, *b), (3, *c), (4, *a), (4, *b), (4, *c), (5, *b), (6, 0, "user", None), (7, 0, "user", "")]
    rows += rows[:3]  # repeated rows
    rows += [(None, 0, "user", "x"), (8, None, "user", "x")]
    out = {r.conv_id: r for r in convs(spark, rows)}
    assert set(out) == {3, 5, 6, 7}  # 1 and 2 are prefixes, 4 repeats 3, 5 begins elsewhere
    assert out[3].copies == 2 and out[3].n_turns == 3
    assert out[3].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert out[6].text == out[7].text


def test_chat_long_conversation_in_parts_and_delimiters(spark):
    rows = [(1, t, "user", f"t{t} <|im_end|>") for t in range(600)] + [(2, t, "user", f"t{t} <|im_end|>") for t in range(599)]
    out = sorted(convs(spark, rows), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in out] == [(1, 0, 600), (1, 1, 600), (1, 2, 600)]
    text = "".join(r.text for r in out)
    assert text.count("<|im_end|>") == 600 and text.count("< |im_end|>") == 600


def test_chat_empty(spark):
    assert convs(spark, []) == []


def test_rules_by_hand(spark):
    cases = {
        "https://a.EXAMPLE.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://xexample.net/en/": ("xexample.net", "/en/", "net/", "block"),
        "http://b.example.com/de/x?y#z": ("b.example.com", "/de/x", "example.com/de/", "block"),
        "http://b.example.org/fr/": ("b.example.org", "/fr/", "org/fr/", "allow"),
        "http://net?q=/": ("net", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://É.net/": ("É.net", "/", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(cases)], "page_id long, url string, host string, n long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, labels).collect()}
    assert got == dict(enumerate(cases.values()))


def test_bad_host_is_blocked_and_small_ones_shrink(spark):
    pages, labels = [], []
    for i in range(200):
        host = "bad.a.org" if i < 60 else "good.a.org" if i < 190 else "few.b.org"
        pages.append((i, f"http://{host}/p{i}"))
        labels.append((i, 1, 1) if i < 60 else (i, 1, 0))
    labels[-1] = (199, 0, 1)
    labels += [(199, None, None), (None, 0, 1)]
    out = url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                                    spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = {r.host: r for r in out}
    assert by["bad.a.org"].verdict == "block" and by["good.a.org"].verdict == "allow"
    assert 0 < by["few.b.org"].bad_rate < 0.5 and by["few.b.org"].host_labelled == 10
    assert len(out) == 200


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


TEXTS = [
    None, "", "nothing here", "a@b.c_d@e.f x@@y.z", "é😀 me@host.example.org, 1.2.3.4 and 1.2.3.256 and 001.02.3.4 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112; 4111111111111111", "+1 (017) 555-7713 +12 +1234567890123456 +1-2-3-4-5-6-7-8-9 ",
    "5555555555554444" * 3, "9" * 5000 + " " + "a" * 20000 + "@", "my iban DE89 3704 0044 0532 0130 00 xDE89370400440532013000",
    "ssn 123-45-6789 but 123-45-6789 alone far away from any word that would tell what this number may be: 987-65-4321",
    "call 555 123 4567", "1.1.1.1@2.2.2.2", "a.b+c@x-y.z-w.. @a.b c@d",
]


def test_pii_base_spans_match_plain_python(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], 0)], "doc_id long, text string, n_email long")
    for r in pii.pii_report(df).collect():
        want = base_spans(TEXTS[5 if r.doc_id is None else r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, want)
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
        n = Counter(k for *_, k in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert got[9] == "iban:8:35"  # mod-97 holds; the second one is part of a word
    assert got[10] == "ssn:4:15,ssn:20:31"  # the last number is too far from the word
    assert got[11] == "tel:5:17"


def test_redact(spark):
    df = spark.createDataFrame([(0, "x 1.1.1.1@2.2.2.2 y", 1), (1, None, 2), (2, "plain", 3), (3, "é 4111111111111111", 4)], "i int, text string, __x int")
    assert [r.text for r in pii.redact(df).orderBy("i").collect()] == ["x [EMAIL] y", None, "plain", "é [CARD]"]


def poisson_copies(seed, key, rate):
    """Numbers of copies per draw, in plain Python."""
    draws = max(1, math.ceil(rate / mixing.MEAN))
    mean, out = rate / draws, []
    for draw in range(draws):
        text = f"{seed}|{key}" + (f"|{draw}" if draw else "")
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-mean)
        n = k = 0
        while cdf <= u and k < 200:
            n, k = n + 1, k + 1
            p *= mean / k
            cdf += p
        out += [draw * mixing.STRIDE + i for i in range(n)]
    return out


def test_poisson_counts_follow_the_distribution(spark):
    from pyspark.sql import functions as F
    for mean in (0.0, 0.3, 1.0, 7.5, 16.0):
        n = mixing.poisson_count(F.col("u"), F.lit(mean)).alias("n")
        got = [r.n for r in spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u")).select(n).collect()]
        assert abs(sum(got) / 20_000 - mean) < 0.002 * max(1, mean)
        assert abs(sum((x - mean) ** 2 for x in got) / 20_000 - mean) < 0.02 * max(1, mean)
        edge = spark.createDataFrame([(0.0,), (1 - 2.0**-52,)], "u double").select(n).collect()
        assert edge[0].n == 0 and edge[1].n < mixing.STRIDE


def test_mixing_against_plain_python(spark):
    rows = [(i, "x" * (i % 7), f"s{i % 3 if i % 2 else 0}") for i in range(2000)]
    rows += [(None, "n", "s1"), (None, "m", "s1"), (9999, None, None), (10000, "keep", "other"), (7, "", "s1"), (8, "rare", "tiny"), (8, "rare", "tiny"), (3, None, "s2")]
    clash = "doc_id long, text string, source string, rate double, copies int, row int, mix_key string"
    df = spark.createDataFrame([(*r, 0.5, 3, 4, "k") for r in rows], clash)
    for targets in ({"s0": 1.0, "s1": 2.0, "s2": 1.0, "tiny": 4.0, "absent": 3.0}, {"s0": 1.0, "s1": 0.0}):
        out = mixing.mix_sources(df, targets, seed=5)
        assert out.columns == ["doc_id", "text", "source", "rate", "copies", "row", "mix_copy", "mix_key"]
        got = out.collect()
        assert {(r.rate, r.copies, r.row) for r in got} == {(0.5, 3, 4)}
        sizes = Counter()
        for _, t, s in rows:
            if s in targets:
                sizes[s] += len(t or "")
        weights = sum(w for s, w in targets.items() if sizes[s] > 0 and w > 0)
        want = Counter()
        for d, t, s in rows:
            key = f"null|{hashlib.md5(t.encode()).hexdigest()}" if d is None else d
            rate = targets[s] / weights * sum(sizes.values()) / sizes[s] if s in targets else None
            want.update((d, t, s, c) for c in ([0] if rate is None else poisson_copies(5, key, rate)))
        assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in got) == want


def test_mixing_takes_the_sources_present(spark):
    rows = [(i, "x" * 10, "hot" if i % 10 else f"rare{i % 4}") for i in range(2000)] + [(9999, "x" * 10, None), (9998, "", "empty"), (9997, None, "empty")]
    got = Counter(r.source for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got[None] == 1 and set(got) == {None, "hot", "rare0", "rare2"}
    assert all(abs(got[s] - 2000 / 3) < 150 for s in ("hot", "rare0", "rare2"))


def test_mixing_many_sources(spark):
    from pyspark.sql import functions as F
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    n = mixing.mix_sources(docs).count()
    assert abs(n - 100_000) < 2_000


def test_mixing_a_rare_source_and_null_ids(spark):
    from pyspark.sql import functions as F
    hot = spark.range(30).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 20_000), F.col("id").cast("string")).alias("text"), F.lit("hot").alias("source"))
    rare = spark.createDataFrame([(1, "xyz", "rare")], hot.schema)
    out = mixing.mix_sources(hot.union(rare)).groupBy("source", F.col("doc_id").isNull().alias("no_id")).agg(F.count("*").alias("n"), F.countDistinct("mix_copy").alias("c"))
    got = {r.source: r for r in out.collect()}
    assert abs(got["rare"].n - 100_030) < 3_000 and got["rare"].n == got["rare"].c  # a rate of a hundred thousand
    assert 0 < got["hot"].n < 30  # half of the rows: each has a draw of its own


def test_mixing_very_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab" * 2_000_000, "a"), (2, "x" * 4_000_000, "b")], "doc_id long, text string, source string")
    assert {len(r.text) for r in mixing.mix_sources(df, seed=3).collect()} <= {4_000_000}
    out = mixing.mix_sources(df.limit(0))
    assert out.count() == 0 and out.columns == [*df.columns, "mix_copy", "mix_key"]


def test_pii_of_many_matches_in_one_text(spark):
    n = 20_000
    line = lambda i: f"user{i}@mail.example.com from 10.0.{i % 256}.7\n"
    df = spark.createDataFrame([(1, "".join(map(line, range(n))), "k", 2)], "doc_id long, text string, __pii string, x int")
    r = pii.pii_report(df).collect()[0]
    at, want = 0, []
    for i in range(n):
        email, ip = f"user{i}@mail.example.com", f"10.0.{i % 256}.7"
        want += [f"email:{at}:{at + len(email)}", f"ip:{at + len(email) + 6}:{at + len(email) + 6 + len(ip)}"]
        at += len(line(i))
    assert r.n_email == r.n_ip == n and r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    out = pii.redact(df).collect()[0]
    assert out.text == "[EMAIL] from [IP]\n" * n and (out.doc_id, out["__pii"], out.x) == (1, "k", 2)


def test_pii_pieces_across_blocks(spark):
    """Spans and context words at any place of a block of text, behind characters of any width."""
    rows = [(i, "\U0001f600é" * ((pii.TEXT_BLOCK - 60) // 2) + "x " * (i // 2) + " " * (i % 2) + "ssn 123-45-6789, a@b.co " + "y" * 1200 + " 1.2.3.4") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        text = rows[r.doc_id][1]
        spans = [("ssn", "123-45-6789"), ("email", "a@b.co"), ("ip", "1.2.3.4")]
        assert r.spans == ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in spans)
    for r in pii.redact(df).collect():
        text = rows[r.doc_id][1]
        assert r.text == text.replace("123-45-6789", "[SSN]").replace("a@b.co", "[EMAIL]").replace("1.2.3.4", "[IP]")


def test_pii_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii_spans string")
    assert pii.pii_report(df).collect() == [] and pii.redact(df).collect() == [] and pii.redact(df).columns == df.columns
