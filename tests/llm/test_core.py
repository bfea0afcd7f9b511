"""The Spark-free cores against brute force."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from netloom.llm import bpe, decontaminate, html_main, language_id, simhash, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Vocabulary(ranks, public_tokenizers.PATTERN), oracle


CHARS = "ab cdeé'st 1\n\t  .,　漢字éZ\x1c\x85'"


def test_bpe_equals_tiktoken(vocabulary):
    v, oracle = vocabulary
    encoder, r = bpe.Encoder(v, store=500), random.Random(1)
    texts = ["".join(r.choice(CHARS) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["the quick brown fox's tail wasn't\nlong " * 50, "a" * 3000, " " * 500, "\n" * 90, "", "the" * 2000]
    for text, ids in zip(texts, encoder.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_bpe_edits_are_exact_and_local(vocabulary):
    v, oracle = vocabulary
    r = random.Random(2)
    for _ in range(60):
        d = bpe.Document(v)
        for _ in range(6):
            a = r.randint(0, len(d.text))
            new = "".join(r.choice(CHARS) for _ in range(r.randint(0, 9)))
            if r.random() < 0.4:
                d.append(new)
            else:
                d.edit(a, min(len(d.text), a + r.choice([0, 1, 3])), new)
            assert d.ids() == oracle.encode_ordinary(d.text)
    d = bpe.Document(v, "many plain words " * 500)
    d.edit(4000, 4003, "xyz")
    assert d.ids() == oracle.encode_ordinary(d.text) and d.encoded_anew < 60


def shard(docs, items):
    phrases, ids = decontaminate.Phrases(items), []
    for t in docs:
        words = decontaminate.words_of(t)
        ids.append(np.array([phrases.alphabet.get(w, 0) for w in words], np.int64))
    return [(sum(int(b - a) for a, b in s), i) for s, i in decontaminate._shard(ids, phrases)]


def windows_by_hand(docs, items):
    windows, out = defaultdict(set), []
    for item, text in items:
        w = decontaminate.words_of(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k:k + size])].add(str(item))
    for text in docs:
        w, hit, names = decontaminate.words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((len(hit), sorted(names)))
    return out


def test_fm_index_finds_every_window():
    r = random.Random(3)
    for _ in range(150):
        words = [b"a", b"b", b"c", b"d"][:r.randint(1, 4)]
        docs = [b" ".join(r.choice(words + [b"x"]) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        items = [(i, b" ".join(r.choice(words) for _ in range(r.randint(0, 14)))) for i in range(r.randint(0, 5))]
        assert shard(docs, items) == windows_by_hand(docs, items)


def test_pigeonring_keys_and_budgets_lose_no_link():
    r, masks = random.Random(4), simhash.key_masks()
    for _ in range(3000):
        a, flips = r.getrandbits(64), r.sample(range(64), r.randint(0, 4))
        b = a
        for bit in flips:
            b ^= 1 << bit
        starts = [s for s, m in masks if a & m == b & m]
        differ = np.full(len(starts), a ^ b, np.uint64)
        assert starts and simhash.keeps_budgets(differ, np.array(starts)).any()


def test_forest_of_a_group_keeps_its_components():
    r = random.Random(5)
    start, mask = simhash.key_masks()[0]
    for _ in range(60):
        base = r.getrandbits(64) & mask
        fps = sorted({base | (r.getrandbits(64) & ~mask & (0x111 << r.randint(0, 50)) & simhash._ALL) for _ in range(30)})
        x = np.array(fps, np.uint64)
        found = simhash._forest(np.zeros(len(x), int), np.full(len(x), 2), x, np.full(len(x), start))

        def parts(links):
            label = list(range(len(x)))
            for a, b in links:
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
            return sorted(sorted(i for i in range(len(x)) if label[i] == k) for k in set(label))

        every = [(i, j) for i in range(len(x)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4
                 and simhash.keeps_budgets(np.array([fps[i] ^ fps[j]], np.uint64), np.array([start]))[0]]
        assert parts(found) == parts(every) and len(found) < max(1, len(x))


def test_fingerprint_by_hand():
    import xxhash

    for text in (b"", b"One", b"a b c", b"A b\tc d\x0be F", b"x y " * 300):
        words = text.lower().split()
        grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text) == sum(
            1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_anchors_cover_every_window_once():
    r = random.Random(6)
    for n in (399, 400, 401, 5000, 70000, 140000):
        text = bytes(r.choice(b"abc ") for _ in range(n))
        _, place, first, last, _ = suffix_dedup.anchors(text)
        covered = [w for a, b in zip(first, last) for w in range(a, b + 1)]
        assert covered == list(range(max(0, n - 399)))
        assert all(b <= p <= a + 300 for p, a, b in zip(place, first, last))


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<aside>Side</aside><article><header><h1>Title &amp; more</h1></header><p>One<b> bold<br>line</p><p>Two &eacute;&#8217;
 white   space<form><input>Send</form><ul><li>first<li>second</ul><div class="ad">Buy</div>
<section id="comments"><p>Nice post</p></section></article><footer>&copy; me</footer><!-- gone"""


def test_main_text_leaves_the_other_parts_out():
    assert html_main.main_text(PAGE, {}) == "Title & more\nOne bold line\nTwo é’ white space\nfirst\nsecond"
    assert html_main.main_text("", {}) == ""
    assert html_main.main_text("<div>Plain text</div><ul><li><a href=1>Link</a></li></ul>", {}) == "Plain text"
    assert html_main.main_text("a < b and <p unclosed", {}) == "a < b and"


def test_language_model_and_rejection():
    r = random.Random(7)
    words = {"en": "the of and with from that".split(), "de": "der die und nicht für über".split()}
    text = lambda k: " ".join(r.choice(words[k]) for _ in range(30)).encode()
    train = [(text(k), k) for k in words for _ in range(60)]
    model = language_id.Model(np.stack([language_id.gram_counts(t) for t, _ in train]).astype(np.float32), [k for _, k in train])
    asked = [text("en"), text("de"), "Ωμέγα βήτα γάμμα".encode()]
    names, score, rejected = model.predict(np.stack([language_id.gram_counts(t) for t in asked]))
    assert names[:2] == ["en", "de"] and list(rejected) == [False, False, True] and (0 <= score).all() and (score <= 1).all()
    assert not language_id.has_letter(b"12 !") and not language_id.has_letter(None) and language_id.has_letter("é".encode())


def test_chain_uses_earlier_categories():
    r = random.Random(8)
    rows, labels = [], []
    for _ in range(400):
        first = r.random() < 0.4
        rows.append(np.array([0] if first else [1 + r.randrange(3)]))
        labels.append((int(first), int(first)))
    chain = toxicity.Chain(["a", "b"], [b"bad", b"w", b"x", b"y"], rows, np.array(labels))
    p = chain.predict([b"Bad!", b"w x", b"", None])
    assert (p[0] > 0.9).all() and (p[1] < 0.1).all() and (p[2:] == 0).all()
    assert chain.models[1][1][0] > 0  # the second model leans on the first
    one_class = toxicity.Chain(["a"], [b"w"], [np.array([0])] * 5, np.zeros((5, 1)))
    assert 0 < one_class.predict([b"w"])[0, 0] < 0.2
