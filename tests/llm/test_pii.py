import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import pii

from .helpers import docs_of, odd_pairs, rows_of, sample, sha

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = "".join(c for c in m[0] if c in "0123456789")
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out[kind].append(m.span())
    return out


def base(found):
    return {k: found[k] for k in PATTERNS}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.b-12 3()+4_%é٣", max_size=60))
def test_any_text(text):
    assert base(pii.Finder().find(text)) == plain(text)


def test_random_and_real_texts(spark):
    finder, rng = pii.Finder(), random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(["a@.b-1", "12.3@+ ", "+1 (2)-3.4", "0123456789 -"])) for _ in range(rng.randint(0, 45)))
        assert base(finder.find(t)) == plain(t), t
    for _, t in sample(spark):
        assert base(finder.find(t)) == plain(t)


def test_added_kinds():
    f = pii.Finder().find("see https://a.example.org/x?y=1, iban DE89 3704 0044 0532 0130 00 ok, password=e1c093f22d39 token = \"97ffa88d7c\" account DE00 3704 0044 0532 0130 00")
    assert [len(f[k]) for k in ("url", "account", "secret")] == [1, 1, 2]
    assert pii.Finder().find("password is the word; tokens are many")["secret"] == []


def test_numbers_that_run_into_each_other():
    f = pii.Finder().find("x +1 (578) 555-6437 4918187128635271 y 4012888888881881-4918187128635271")
    assert f["phone"] == [] and f["phone+"] == [(2, 19)] and f["card+"] == [(20, 36), (39, 55), (56, 72)]
    assert pii.Finder().find("1234567890 1234567890 1234567890")["card+"] == []


def test_hard_texts_are_linear():
    """Four times the text takes four times as long, with a margin for other work on the machine."""
    finder = pii.Finder()
    for part in ("a", "@", "a@", "1.", "1 ", "+1", "(", "iban ", "DE89", "token=a1", "http://a.", "1-2.3 "):
        times = []
        for n in (25_000, 100_000):
            text = "+1 " + part * n
            began = time.process_time()
            finder.find(text)
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 0.2, (part, times)


def test_rows(spark):
    pairs = odd_pairs() + [(50, "é x@y.zz 4012-8888-8888-1881 +1 (632) 555-4827 at 10.0.0.255")]
    got = pii.span_digests(pii.find_spans(docs_of(spark, pairs)))
    want = []
    for i, t in pairs:
        p = plain(t)
        spans = sorted((s, n, k, e) for n, k in enumerate(PATTERNS) for s, e in p[k])
        want.append((i, *(len(p[k]) for k in PATTERNS), sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))))
    assert rows_of(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == sorted(want, key=repr)
    assert got.where("doc_id = 50").first()["n_spans"] == 4 and got.where("doc_id = 50").first()["spans"] == "email:2:8,card:9:28,phone:29:46,ip:50:60"
    assert pii.find_spans(docs_of(spark, [])).count() == 0
    assert rows_of(pii.redact(docs_of(spark, [(1, "mail x@y.zz now"), (2, None)]))) == [(1, "mail <email> now"), (2, None)]


def test_accounts_anywhere_behind_a_cue():
    first, second = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    accounts = lambda t: [t[a:b] for a, b in pii.Finder().find(t)["account"]]
    assert accounts(f"account holder Maria Mustermann, Berlin: {first}") == [first]
    for gap in range(70):
        assert accounts("iban" + " " * gap + first) == [first]  # of a known country, so the reach of the cue doesn't matter
        unknown = next(f"QQ{c:02d}" for c in range(2, 99) if pii.iban_holds(f"QQ{c:02d}" + first[4:].replace(" ", ""))) + first[4:]
        assert accounts("iban" + " " * gap + unknown) == [unknown] * (gap <= 60)
    assert accounts(f"IBAN: {first}, or {second}.") == [first, second]
    assert accounts(f"iban {first} / {second} / {first}; account {second}") == [first, second, first, second]
    assert accounts(f"iban AB12 is no. Not DE00 3704 0044 0532 0130 00, but {first}") == [first]
    assert accounts(f"iban XX00 1111 2222 3333 {first}") == [first]
    pii.Finder().find("iban " * 50_000 + "DE89" * 50_000 + (first + " ") * 10_000)


def test_whole_secrets(spark):
    value = "0aB3" * 1000
    t = f"token={value} end"
    assert pii.Finder().find(t)["secret"] == [(6, 4006)]
    assert rows_of(pii.redact(docs_of(spark, [(1, t)]))) == [(1, "token=<secret> end")]
    pii.Finder().find("token" * 100_000 + "=" + "token1" * 100_000)


def test_recall_by_kind():
    """Planted values of every kind between random words and punctuation, all of which are known."""
    rng, finder = random.Random(8), pii.Finder()
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digit(15).replace("0", "4", 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        country = rng.choice(["DE", "FR", "GB", "ES"])
        body = digit(pii.IBAN_LENGTHS[country] - 4)
        return country + next(f"{c:02d}" for c in range(2, 99) if pii.iban_holds(f"{country}{c:02d}{body}")) + body

    make = {
        "email": lambda: f"a.b{digit(2)}@mail{digit(1)}.example.com", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({digit(3)}) 555-{digit(4)}",
        "url": lambda: f"https://h{digit(2)}.example.org/p?q={digit(3)}", "account": iban,
        "secret": lambda: f"{rng.choice(['apiKey', 'API_Key', 'token', 'Password', 'access-key', 'clientSecret'])}{rng.choice(['=', ': ', ' = '])}\"{'%040x' % rng.getrandbits(160)}a1\"",
    }
    for kind, value in make.items():
        caught = 0
        for _ in range(300):
            v, words = value(), [rng.choice(["the", "of.", "Ende,", "été", "(so)", "a!"]) for _ in range(12)]
            t = " ".join(words[:6] + [v] + words[6:])
            found = finder.find(t)
            spans = found[kind] + found.get(f"{kind}+", [])
            caught += any(t.index(v) <= a and b <= t.index(v) + len(v) for a, b in spans)
        assert caught / 300 >= 0.99, kind


def test_redaction_leaves_nothing():
    finder = pii.Finder()
    assert pii.redact_text(finder, "call +1 415 4012-8888-8888-1881 now") == "call <phone> now"
    rng = random.Random(9)
    for _ in range(3_000):
        t = "".join(rng.choice(rng.choice(["a@.b-1", "12.3@+ ", "+1 (2)-3.4", "4012888888881881 -", "0123456789 -"])) for _ in range(rng.randint(0, 45)))
        gone = {i for spans in finder.find(t).values() for a, b in spans for i in range(a, b)}
        assert re.sub("<[a-z]+>", "", pii.redact_text(finder, t)) == "".join(c for i, c in enumerate(t) if i not in gone)


def test_cues_in_any_case():
    secrets = lambda t: [t[a:b] for a, b in pii.Finder().find(t)["secret"]]
    for cue in ("apiKey", "API_Key", "api-key", "AccessKey", "myToken", "PassWord", "client_secret"):
        assert secrets(f"İ {cue}: 'abc123def456'") == ["abc123def456"], cue
