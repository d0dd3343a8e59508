"""Secret scans, personal data, chat formatting and token counts against plain versions."""

import hashlib
import json
import random
import re

import pytest

from lattica.llm import chat, pii, secrets, tokens
from lattica.llm.automata import compile_rules

ODD_ROWS = "doc_id long, text string, spans string, n_bytes int"


def odd_table(spark, rows):
    """A documents table with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ODD_ROWS)


def accepts(dfa, data):
    state = dfa.start
    for b in data:
        state = dfa.table[state | b]
    return dfa.rules.get(state, 0)


@pytest.mark.parametrize("pattern", ["ab*c", "(?i:ab|cd)+[0-9]{2,3}", "a?b{2,}", r"[^a-c]\x41\.", "x{0,2}y|z"])
def test_automata(pattern):
    dfa, rng = compile_rules([pattern]), random.Random(1)
    own = re.compile(pattern.encode(), re.S)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcABCdDxyz01.") for _ in range(rng.randint(0, 7)))
        assert bool(accepts(dfa, data)) == bool(own.fullmatch(data)), data


def test_automata_are_minimal():
    assert compile_rules(["a(b|c)", "d"]).states == compile_rules(["ab|ac", "d"]).states
    assert accepts(compile_rules(["ab", "a[bc]"]), b"ab") == 3


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_random():
    rng, scanner = random.Random(5), secrets.scanner_for(secrets.RULES)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "abc", "abcdef1", "/", "AKIA", "AKIAABCD", "0123456789abcdef", "deadbeef", "é", "\n", "==", "A1B2C3D4E5F6G7H8"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [s for s in scanner.spans(text) if s[2] in secrets.BASE] == base_secrets(text), text


def test_secrets_edges(spark):
    long = "secret=token:" + "a1" * 50_000
    rows = [(1, None), (2, ""), (3, "ß token = 'abcdef' x"), (3, "ß token = 'abcdef' x"), (None, "AKIA" + "A" * 16), (5, long), (6, "ghp_" + "xY" * 18)]
    got = {(r.doc_id, r.spans): r for r in secrets.secret_scan(odd_table(spark, rows)).collect()}
    assert (1, "") in got and (2, "") in got
    assert got[3, "assign:2:17"].n_assign == 1
    assert got[None, "access:0:20"].n_access == 1
    assert got[6, "github:0:40"].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_scan(odd_table(spark, [])).count() == 0


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_exact_forms_random():
    rng = random.Random(5)
    parts = ["a.b", "@", "x@y.com", "@@", ".com", "-", "+", "1", "12", "255", "256", "007", " ", ".", "(", ")", "4111111111111111", "4012 8888", "8888 1881", "é", "\n", "+1 (988) 555-2485", "10.0.0.1", "1.2.3", ".4.5"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert sorted(pii.exact_forms(text)) == base_pii(text), text


def test_viterbi_is_the_best_path():
    field = pii.default_field()
    decoder, rng = pii.Decoder(field), random.Random(1)
    lines = [[bytes(rng.choice(b"aA0@.+-") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))] for _ in range(20)]
    for words, labels in zip(lines, decoder.decode([decoder.number(w) for w in lines]), strict=True):
        scores = [field.scores(w) for w in words]
        width, k = len(pii.shape_features(b"a")), len(pii.LABELS)

        def total(path, words=words, scores=scores):
            out = width * field.before[pii.BUCKETS][path[0]] + width * field.after[pii.BUCKETS][path[-1]]
            for t in range(len(words)):
                out += scores[t][0][path[t]]
                if t:
                    out += scores[t - 1][1][path[t]] + field.pairs[path[t - 1], path[t]]
                if t + 1 < len(words):
                    out += scores[t + 1][2][path[t]]
            return out

        paths = [[]]
        for _ in words:
            paths = [[*p, x] for p in paths for x in range(k)]
        assert total(labels.tolist()) == pytest.approx(max(map(total, paths)), abs=1e-3)


def test_field_held_out():
    decoder = pii.Decoder(pii.default_field())
    text = "write to kim.lee@mail.example.net or call +1 (646) 555-0123 about 192.0.2.44 and card 4222222222222 please"
    kinds = {k for _, _, k in pii.find([text], decoder)[0]}
    assert {"email", "phone", "ip", "crf_card"} <= kinds
    assert pii.find(["the cat sat on the mat in 1999, twice."], decoder) == [[]]
    assert pii.find(["pay with card 4242424242424241 please"], decoder) == [[]], "a number that fails its test is no card"


def test_field_recall_by_kind():
    """Lines that are made by rule, none of which is in the labelled table: what is found as a whole, and what else."""
    rng = random.Random(3)
    words = "the of report we saw office again before please answer value table number system green market".split()

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while not pii.luhn(number := f"4{digits(15)}"):
            pass
        return rng.choice(["", " ", "-"]).join(re.findall("....", number))

    make = {
        "email": lambda: f"{rng.choice(words)}{rng.choice('._-')}{rng.choice(words)}@{rng.choice(words)}.{rng.choice(['com', 'org', 'co.uk'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "none": lambda: rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.randint(1, 9)},{digits(3)}", f"{rng.randint(1, 99)}.{digits(2)}", f"order {digits(8)}", "4242424242424241", f"{rng.randint(10, 23)}:{digits(2)}"]),
    }
    decoder, found, other = pii.Decoder(pii.default_field()), dict.fromkeys(make, 0), 0
    for kind in list(make) * 200:
        item = make[kind]()
        before = "".join(f"{w} " for w in rng.choices(words, k=rng.randint(0, 5)))
        text = f"{before}{item}{rng.choice(['', ',', '.'])} {' '.join(rng.choices(words, k=rng.randint(0, 5)))}"
        spans = {(s, e, k.removeprefix("crf_")) for s, e, k in pii.find([text], decoder)[0]}
        whole = (len(before), len(before) + len(item), kind)
        found[kind] += whole in spans
        other += len(spans - {whole})
    assert all(found[k] >= 0.95 * 200 for k in pii.BASE), found
    assert other <= 0.01 * 1000, other


def test_pii_edges(spark):
    rows = [(1, None), (2, "é a@b.co"), (None, "1.2.3.4"), (4, "1" * 30_000), (4, "@" * 5000)]
    got = {(r.doc_id, r.n_email, r.n_ip): r for r in pii.personal_data(odd_table(spark, rows)).collect()}
    assert got[2, 1, 0].spans == "email:2:8"
    assert (None, 0, 1) in got and (1, 0, 0) in got
    assert pii.personal_data(odd_table(spark, [])).count() == 0


def test_chat_round_trip():
    rng = random.Random(3)
    pieces = ["</s>", "[INST]", "\\", "<|end|>", "\n", "a", "é", "<|turn|>", "\\l", ""]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "<x>\n"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        made = chat.render(turns)
        assert chat.read_back(made.text) == turns and not made.rewritten
        assert [made.text[s:e] for s, e in made.spans] == [chat.chat_template([t]) for t in turns]
        assert [chat.unescape(made.text[s:e]) for s, e in chat.loss_spans(made)] == [t for r, t in turns if r == "assistant"]
        assert not any(mark in chat.escape(t) for _, t in turns for mark in ("</s>", "[INST]", chat.CLOSE))


def test_rewriting_templates_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat.render(turns, chat.short_memory_template).rewritten == [2]


def test_chat_edges(spark):
    rows = [(1, None, None, None, "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"), (None, 0, "user", "q" * 70_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return tokens.WordBpe(public.path(tokens.TOKENIZER)), public.path(tokens.TOKENIZER)


def test_tokens_as_the_library(bpe):
    from tokenizers import Tokenizer

    own, path = bpe
    library, rng = Tokenizer.from_file(path), random.Random(1)
    alphabet = "abcAB 019'sdmtvelr\n\t.,!?<|>éÉßΣσİı漢字ｱ①½\x1c\x1f\x85\xa0　é​😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>hi<|startoftext|>", "<|endoftext|", "", "a" * 3000, "aaa aa a aaaa", "İSTANBUL ΑΣ ΌΣΟΣ"]
    assert own.count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_memory_may_be_forgotten(bpe, monkeypatch):
    own, _ = bpe
    before = own.count(["one two three", "four five"])
    monkeypatch.setattr(tokens, "REMEMBERED", 0)
    assert own.count(["one two three", "four five"]) == before


def test_token_edges(spark, bpe):
    got = {(r.doc_id, r.n_bytes): r for r in tokens.token_counts(odd_table(spark, [(1, None), (None, "é"), (3, "a b " * 2000)]), bpe[1]).collect()}
    assert got[1, 0].n_tokens == 0 and got[None, 2].n_tokens == 1
    assert got[3, 8000].n_tokens == 4000 and got[3, 8000].over_limit


def test_vocabulary_file_is_what_is_expected(bpe):
    with open(bpe[1], encoding="utf-8") as f:
        spec = json.load(f)
    assert spec["model"]["end_of_word_suffix"] == "</w>"
    assert spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed"


def test_long_words_and_many_spans():
    """Inputs on which rescanning would take minutes."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from lattica.llm import pii, tokens

    path = public_tokenizers.path(tokens.TOKENIZER)
    library, bpe, rng = Tokenizer.from_file(path), tokens.WordBpe(path), random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aaaé") for n in (300, 4_000)]
    texts += ["a" * 1001, "the" * 700 + " " + "ing" * 400]
    assert bpe.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    began = time.time()
    assert bpe.count(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))])[0] > 100_000
    assert time.time() - began < 120
    line = "é 4111 1111 1111 1112 mail a.b@example.org \n"
    began = time.time()
    spans = pii.find([line * 50_000], pii.Decoder(pii.default_field()))[0]
    assert sum(k == "email" for _, _, k in spans) == 50_000 and time.time() - began < 120
