import random
from collections import Counter
from hashlib import sha256

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from packwright.llm import alignment
from packwright.llm.queries import BYTE_VOCABULARY, vocabulary

ODD = ["a", " ", "  two  blanks ", "▁mark", "a▁b", "<|endoftext|> <s> </s> <unk>", "\U0001f600 été ﬁ 日本語", "x" * 3000, "\x00\x01\t\n", "don't 12345 ...", "The the THE"]


def plain(texts):
    """Links counted pair by pair over byte ranges."""
    tok = Tokenizer.from_str(vocabulary(BYTE_VOCABULARY).decode())
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary())
    letters = alignment.byte_letters()
    docs, totals = [], Counter()
    for text in texts:
        row = None
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            spelled_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
            spelled_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
            if b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(s) for s in spelled_a]).tolist(), np.cumsum([len(s) for s in spelled_b]).tolist()
                begins_a, begins_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
                links = [(i, j) for i in range(len(a)) for j in range(len(b)) if begins_a[i] < ends_b[j] and begins_b[j] < ends_a[i]]
                groups = []
                for cut in sorted(set(ends_a) & set(ends_b)):
                    before = groups[-1][0] if groups else 0
                    groups.append((cut, [x for x, e in zip(a, ends_a) if before < e <= cut], [x for x, e in zip(b, ends_b) if before < e <= cut]))
                line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in groups)
                row = (len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], line)
                totals.update(row[3])
        docs.append(row)
    highest = {}
    for (_, b), n in totals.items():
        highest[b] = max(highest.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (r[0], r[1], r[2], len(r[3]), sum(totals[p] == highest[p[1]] for p in r[3]), sum(totals[p] for p in r[3]), sha256(r[4].encode()).hexdigest())
        for r in docs
    ]


def key(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def aligned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = alignment.align(docs, vocabulary(BYTE_VOCABULARY), vocabulary(), alignment.Params(**options))
    rows = {r.doc_id: key(r) for r in found.collect()}
    return [rows[i] for i in range(len(texts))]


def test_texts_against_all_pairs_of_ranges(spark, sf_small):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect() if r.text and len(r.text) < 1500][:60]
    texts += ODD + [None, "", *ODD[:3]]
    want = plain(texts)
    assert want[texts.index("a▁b")][0] == 0 and want[0][0] > 0
    assert aligned(spark, texts) == want
    assert aligned(spark, texts, slice_bytes=500) == want


def test_every_token_comes_to_the_last_of_its_group():
    draw = random.Random(5)
    for _ in range(200):
        total = draw.randrange(1, 60)
        ends = [np.array(sorted({*draw.sample(range(1, total + 1), draw.randrange(0, total)), total})) for _ in range(2)]
        a, b = ends
        label = alignment.terminals(alignment.farthest(a, b))
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        group = lambda end: next(i for i, c in enumerate(cuts) if end <= c)
        last = [len(a) + int(np.searchsorted(b, c)) for c in cuts]
        assert label.tolist() == [last[group(e)] for e in [*a.tolist(), *b.tolist()]]
        from_a, from_b = alignment.linked_tokens(a, b)
        ranges = lambda e: list(zip([0, *e[:-1]], e))
        want = [(i, j) for i, (x, y) in enumerate(ranges(a.tolist())) for j, (u, v) in enumerate(ranges(b.tolist())) if x < v and u < y]
        assert sorted(zip(from_a.tolist(), from_b.tolist())) == want


def test_a_chain_over_a_whole_text_takes_few_rounds():
    n = 200_000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    label = alignment.terminals(alignment.farthest(a, b))
    assert (label == len(a) + len(b) - 1).all()


def test_spellings_are_those_of_the_files():
    tok = Tokenizer.from_str(vocabulary(BYTE_VOCABULARY).decode())
    spelled = alignment.byte_level_spellings(vocabulary(BYTE_VOCABULARY))
    assert len(spelled) == tok.get_vocab_size() and spelled[tok.token_to_id("Ġthe")] == b" the"
    pieces = alignment.piece_spellings(alignment.parse_model(vocabulary()))
    assert len(pieces) == 32000 and {bytes([i]) for i in range(256)} <= set(pieces)


def test_both_byte_level_libraries_agree():
    """On every letter that goes to the faster one, in all surroundings that the pattern tells apart."""
    encoder = alignment.ByteLevel(vocabulary(BYTE_VOCABULARY))
    texts = [f" a{c}b {c}{c}  {c} 1{c}2 !{c}? '{c}s  \n{c}\t\t{c} {c}" for c in map(chr, range(0x250))]
    texts += [" " + t for t in ODD] + ["".join(random.Random(1).choices("ab 1'!é\u00a0\u0085\n", k=5000)), "z" * 100_000]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert encoder.fast is not None and not encoder.RARE.search(texts[0x24F]) and encoder.RARE.search("\u0250")


def test_another_vocabulary_is_left_to_its_library():
    content = alignment.json.loads(vocabulary(BYTE_VOCABULARY))
    content["model"]["merges"][:2] = content["model"]["merges"][1::-1]
    other = alignment.ByteLevel(alignment.json.dumps(content).encode())
    assert other.fast is None
    assert [x.tolist() for x in other.encode([" the cat"])] == [other.tokenizer.encode(" the cat").ids]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    files = vocabulary(BYTE_VOCABULARY), vocabulary()
    short = [(i, t) for i, t in edge_rows if len(t or "") < 5000]
    docs = edge_docs.where("text is null or length(text) < 5000")
    got = alignment.align(docs, *files).collect()
    named = lambda i, k: (i is not None, i or 0, k)
    assert sorted(named(r.doc_id, key(r)) for r in got) == sorted(named(i, k) for (i, _), k in zip(short, plain([t for _, t in short])))
    assert alignment.align(edge_docs, *files).count() == len(edge_rows)
    assert alignment.align(no_docs, *files).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {key(r) for r in alignment.align(nothing, *files).collect()} == {(0, 0, 0, 0, 0, 0, "")}
