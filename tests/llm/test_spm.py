import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from windlass.llm import spm

T = spm.Transducer(open(spm.MODEL, "rb").read())
P = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def ids(text):
    return np.frombuffer(T.encode(text), np.int32).tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdehinorst .,\n▁é", max_size=60)))
def test_ids_and_round_trip(text):
    if "\0" not in text:
        assert ids(text) == P.encode(text)
    if spm.MARK not in text:
        assert T.decode(ids(text)) == text


def test_words():
    for text in ["Hello world, tokenization of internationalisation", "  two   runs    of space ", "x" * 300, "haha" * 200, "", " ", "日本語とEmoji 😀 text\tand\r\n"]:
        assert ids(text) == P.encode(text), text


def test_unigram_against_all_paths():
    def field(n, v):
        return bytes([n << 3 | 2, len(v)]) + v

    import struct
    pieces = [("<unk>", 0.0, 2), (spm.MARK, -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -5.0, 1), ("aab", -6.1, 1), (spm.MARK + "a", -2.5, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([24, k])) for p, s, k in pieces)
    t = spm.Transducer(data)

    def best(s):
        if not s:
            return 0.0, []
        found = []
        for n in range(1, len(s) + 1):
            i = t.ids.get(s[:n])
            if i is not None or n == 1:
                c, rest = best(s[n:])
                found.append((c - (t.model.scores[i] if i is not None else t.worst), [i if i is not None else 0, *rest]))
        return min(found, key=lambda x: x[0])

    for text in ["aabab", "abcaab", "a b aab", "c"]:
        got = np.frombuffer(t.encode(text), np.int32).tolist()
        want = best(t.normalise(text))
        cost = sum(-t.model.scores[i] if i else -t.worst for i in got)
        assert abs(cost - want[0]) < 1e-9


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "a b", "y")], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in spm.encode(df, check=True).collect()}
    assert rows[1].ids is None and rows[2].ids == [] and rows[3].round_trip
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(df, keep_text=False)).collect()}
    assert back == {1: None, 2: "", 3: "a b"}
