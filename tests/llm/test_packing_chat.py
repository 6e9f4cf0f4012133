import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import clashing, docs
from tokenizers import Tokenizer

from netloom.llm import chat, packing
from netloom.llm.tokens import Encoder, vocabulary


def _best_fit(lengths, capacity):
    """Best fit decreasing, one item at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return Counter(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity, n in ((10, 40), (64, 300), (2048, 500), (7, 1)):
        lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(n)]
        used, taken = defaultdict(list), Counter()
        for length, lo, hi, first, each, at in packing.plan(Counter(lengths), capacity):
            taken[length] += hi - lo
            for j in range(hi - lo):
                used[first + j // each].append((at + j % each * length, length))
        assert taken == Counter(lengths)
        for items in used.values():
            end = 0
            for at, length in sorted(items):
                assert at == end
                end += length
            assert end <= capacity
        assert Counter(capacity - sum(n for _, n in x) for x in used.values()) == _best_fit(lengths, capacity)
        assert sorted(used) == list(range(len(used)))


ODD = ["", "a", "  two  spaces \n\n\t x  ", "it's we're 'S don't", "naïve Ünïcödé 123 4½ ²", "日本語 text 🙂 😀", "a\x1cb\x85c\xa0d",
       "x<|endoftext|>y", "word " * 30_000, "​ zero­width", "١٢٣ arabic", "  ", "\n \n"]


def test_encoder_equals_the_library():
    own, library = Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for _ in range(2):
        for text in ODD:
            got = np.frombuffer(own.encode(text), "<u4").tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_packing_pieces(spark):
    library = Tokenizer.from_file(vocabulary())
    rows = list(enumerate(ODD)) + [(50, None), (51, "a"), (51, "a")]
    got = packing.pack(clashing(docs(spark, rows)), with_ids=True).collect()
    texts, seen = dict(rows), defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r)
    assert set(seen) == set(texts) and len(seen[51]) == 2
    for doc_id, found in seen.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        found.sort(key=lambda r: r.piece)
        if doc_id == 51:
            found = found[:1]
        assert [r.piece for r in found] == list(range(len(found)))
        at = 0
        for r in found:
            assert r.start == at and zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids) and all(r.length == 2048 for r in found[1:])
        assert len(found) == 1 or found[0].length == (len(ids) % 2048 or 2048)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= 2048
    assert Counter(2048 - sum(n for _, n in x) for x in bins.values()) == _best_fit([r.length for r in got], 2048)
    assert packing.pack(docs(spark, rows).limit(0)).collect() == []


TURNS = [(1, 0, "system", "be <s>good\\</s>"), (1, 1, "user", "[INST]hi[/INST] \\[INST]"), (1, 2, "assistant", " lead\\ [/INST]日本🙂 "),
         (1, 3, "assistant", ""), (1, 4, "assistant", "tail\n"), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "x" * 50_000),
         (None, 0, "assistant", "no id"), (4, 1, "user", "b"), (4, 0, "assistant", "a<"), (4, 0, "[INST]", "s>")]


def _digests(turns):
    groups = defaultdict(list)
    for c, turn, role, text in turns:
        groups[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, own in groups.items():
        own.sort()
        full = "".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(full).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    df = clashing(spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").repartition(4))
    for block in (1 << 20, 1):
        formatted = chat.format_conversations(df, block_chars=block)
        got = chat.read_back(formatted).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == _digests(TURNS)
    whole = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    parts = defaultdict(list)
    for r in chat.format_conversations(df, block_chars=1).orderBy("conv_id", "block").collect():
        parts[r.conv_id] += r.ids
    assert parts == {c: r.ids for c, r in whole.items()}  # blocks encode like the whole
    assert all(len(r.ids) == len(r.mask) == len(r.starts) for r in whole.values())
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_chat_escapes():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "s", ">", "/", "[", "INST", "]", "\\", "<s>", "a", "\n"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in (chat.BEGIN, chat.END, chat.OPEN, chat.CLOSE))
