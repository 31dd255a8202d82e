import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import bpe, encoder, lexicon
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.plans.texts import lcs_length


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_zero_vector_and_dimensions(spark):
    zero, e = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.cosine(zero, e)) == 0.0
    assert one(spark, V.cosine_distance(zero, e)) == 1.0
    assert one(spark, V.normalise(zero)) == [0.0, 0.0]
    assert one(spark, V.normalise(e)) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="dimension"):
        one(spark, V.dot(e, F.array(F.lit(1.0))))
    with pytest.raises(ValueError):
        V.distance("manhattan", e, e)


GOLDEN = [
    ("", ""),
    ("Aq", "ako"),
    ("sooooo", "soo"),
    ("hellooo", "helloo"),
    ("aabb", "aabb"),
    ("nagpainting", "paint"),
    ("magbake", "bake"),
    ("running", "run"),
    ("biking", "bike"),
    ("king", "king"),
    ("naka-upload", "naka upload"),
    ("nakaupload", "upload"),
    ("isa isa na", "isa isa na"),
    ("lakad-lakad tayo", "lakad tayo"),
    ("w/o u", "without you"),
    ("w/friends", "withfriends"),
    ("w/ friends", "w / friends"),
    ("ñaq aq", "ñako ako"),
    ("san ka", "saan ka"),
    ("it's ok!!", "its ok !"),
    ("  spaced \t out ", "spaced out"),
    ("...", "."),
]


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_normalise(spark, text, expected):
    assert one(spark, T.normalise(F.col("t"), lexicon.DEFAULT), t=text) == expected


def test_rule_phases_equal_one_by_one():
    rules = (("a", "b"), ("b", "c"), ("x y", "z"), ("q", "q"), ("z", "a"))
    assert T.phases(rules) == [("lookup", {"a": "b"}), ("lookup", {"b": "c"}), ("regex", {"x y": "z"}), ("lookup", {"z": "a"})]


def test_trace_names_every_stage(spark):
    rows = T.trace(spark.createDataFrame([("Aq  nagpainting",), ("",)], ["t"]), "t", lexicon.DEFAULT).collect()
    assert [r["rule"] for r in rows] == list(T.STAGES)
    assert [r["fired"] for r in rows] == [True, True, False, False, True, True, False]


@given(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=20))
def test_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert lcs_length(a, b) == table[-1, -1]


def test_bpe():
    tokenizer = bpe.Tokenizer({"<pad>": 0, "<eos>": 1, "<bos>": 2, "<unk>": 3, "▁": 4, "a": 5, "b": 6, "ab": 7, "aba": 8}, {("a", "b"): 0, ("ab", "a"): 1})
    assert tokenizer.pieces("abab") == ["ab", "ab"]
    assert tokenizer.pieces("aba b") == ["aba", "▁", "b"]
    assert tokenizer.encode("aba", 4) == [8, 1, 0, 0]
    assert tokenizer.encode("b b b b", 4) == [6, 4, 6, 1]
    assert tokenizer.raw("zzya") == [3, 5]
    assert tokenizer.decode([8, 4, 6, 1, 0]) == "aba b"
    forced = bpe.Tokenizer(tokenizer.vocabulary, tokenizer.ranks, eos_in_cut=True)
    assert forced.encode("b b", 3) == [6, 4, 1]


def test_bpe_from_json_and_bytes():
    text = '{"model": {"vocab": [["<pad>", 0], ["<eos>", 0], ["<bos>", 0], ["<unk>", 0], ["a", 0], ["<0xC3>", 0], ["<0xA9>", 0]], "merges": ["a a", ["b", "c"]], "byte_fallback": true}, "added_tokens": [{"id": 9, "content": "x"}]}'
    tokenizer = bpe.Tokenizer.from_json(text)
    assert tokenizer.raw("aé") == [4, 5, 6]
    assert tokenizer.raw("x") == [9]
    assert ("b", "c") in tokenizer.ranks


@settings(max_examples=30)
@given(st.text("abcdefghij ", max_size=40))
def test_bpe_round_trip(text):
    tokenizer = bpe.letters_tokenizer()
    assert tokenizer.decode(tokenizer.raw(text)) == text.strip()


class _Counted(dict):
    """Ranks that count how often they are asked."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


@pytest.mark.parametrize("sign", ["", " "])
def test_bpe_merges_long_texts_in_few_steps(sign):
    pairs = bpe.letters_tokenizer().ranks | {("ae", "in"): 64, ("or", "st"): 65, ("aein", "orst"): 66}
    ranks = _Counted(pairs)
    text = f"aeinorst{sign}" * 250
    assert bpe.Tokenizer({}, ranks).pieces(text) == ["aeinorst", *"▁"[: len(sign)]] * 250
    assert ranks.asked < 20 * len(text)


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12), st.text("abcd é", max_size=60))
def test_bpe_merges_by_the_plain_rule(picks, text):
    tokens, ranks = list("abcd▁"), {}
    for i, (left, right) in enumerate(picks):
        pair = (tokens[left % len(tokens)], tokens[right % len(tokens)])
        ranks[pair] = len(picks) - i if i % 3 else i
        tokens.append("".join(pair))
    symbols = list(text.replace(" ", "▁"))
    while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
        i = min(found)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    tokenizer = bpe.Tokenizer({}, ranks)
    assert tokenizer.pieces(text) == symbols
    assert tokenizer.pieces(text) == symbols  # with the stretches that are remembered


def test_pictures():
    ramp = np.tile(np.arange(8.0)[None, :, None], (8, 1, 3))
    assert encoder.resize_bilinear(ramp, 8, 8) == pytest.approx(ramp)
    assert encoder.picture_input(np.full((4, 4, 3), 255)).max() == pytest.approx(1.0)
    points = np.array([[0.0, 0], [1, 0], [0, 1]])
    moved = points @ np.array([[0.0, 2], [-2, 0]]) + [3, 4]
    matrix = encoder.similarity_transform(points, moved)
    assert points @ matrix[:, :2].T + matrix[:, 2] == pytest.approx(moved)
    assert encoder.warp(ramp, np.array([[1.0, 0, 0], [0, 1, 0]]), 8) == pytest.approx(ramp)


def test_pictures_of_all_sizes():
    rng = np.random.default_rng(0)
    large = rng.integers(0, 256, size=(1000, 700, 3))
    nearest = large[np.arange(448) * 1000 // 448][:, np.arange(448) * 700 // 448]
    assert np.array_equal(encoder.picture_input(large), encoder.picture_input(nearest))
    assert encoder.within_side(large).shape == (512, 358, 3) and encoder.within_side(large[:100, :100]) is not large
    small = rng.integers(0, 256, size=(4, 6, 3), dtype=np.uint8)
    assert np.array_equal(encoder.decode_picture(b"P6\n# made here\n6 4\n255\n" + small.tobytes()), small)
    assert encoder.decode_picture(b"P6 6 4 255 short") is None and encoder.decode_picture(b"no picture") is None
    whole, scale, pad_x, pad_y = encoder.letterbox(np.full((10, 20, 3), 255), 40)
    assert (scale, pad_x, pad_y) == (2.0, 0.0, 10.0) and whole.shape == (3, 40, 40)
    assert np.allclose(whole[:, 10:30], 127.5 / 128) and np.allclose(whole[:, :10], -127.5 / 128) and np.allclose(whole[:, 30:], -127.5 / 128)


def test_faces_without_points_are_cut_out():
    pixels = np.zeros((50, 60, 3))
    pixels[10:30, 20:40] = 255
    target = np.array([[0.0, 0], [111, 0], [0, 111], [111, 111], [55.5, 55.5]])
    for points in (None, np.zeros((5, 2))):
        assert np.allclose(encoder.face_input(pixels, points, target, (20, 10, 40, 30)), 1)
    assert encoder.face_input(pixels, None, target, (-5, -5, -1, -1)).shape == (3, 112, 112)
    corners = np.array([[20.0, 10], [39, 10], [20, 29], [39, 29], [29.5, 19.5]])
    assert np.allclose(encoder.face_input(pixels, corners, target, (0, 0, 1, 1))[:, 2:-2, 2:-2], 1)


def test_large_rule_tables_equal_one_by_one(spark):
    """Hundreds of rules with chained keys, slashes and several words against one substitution after the other."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "ng", "s", "t", "k")]
    rules = {}
    while len(rules) < 400:
        key = str(rng.choice(words))
        if rng.random() < 0.06:
            key = [f"{key} {rng.choice(words)}", f"{key}/", f"{key}/{rng.choice(words)}"][int(rng.integers(3))]
        rules.setdefault(key, " ".join(rng.choice(words, int(rng.integers(1, 3)))))
    assert len(T.phases(list(rules.items()))) < 200
    texts = [" ".join(rng.choice([*words, *rules, "x/y", "q"], 50)) for _ in range(60)]
    wanted = []
    for text in texts:
        for key, value in rules.items():
            after = r"(?![a-z0-9_])" if key[-1] != "/" else r"(?=[a-z0-9_])"
            text = re.sub(rf"(?<![a-z0-9_]){re.escape(key)}{after}", value, text)
        wanted.append(text)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["t"] for r in frame.select("i", T.substitute(F.col("t"), T.Lexicon(rules=tuple(rules.items()))).alias("t")).orderBy("i").collect()]
    assert got == wanted and got != texts


def tiny_model():
    """Bytes of an ONNX model that casts token ids to floats: protocol buffer fields by hand."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    number = lambda field, n: varint(field << 3) + varint(n)
    block = lambda field, content: varint(field << 3 | 2) + varint(len(content)) + content
    shape = block(2, block(1, block(2, b"n")) + block(1, block(2, b"l")))
    value = lambda name, kind: block(1, name) + block(2, block(1, number(1, kind) + shape))
    cast = block(1, b"input_ids") + block(2, b"out") + block(4, b"Cast") + block(5, block(1, b"to") + number(3, 1) + number(20, 2))
    graph = block(1, cast) + block(2, b"g") + block(11, value(b"input_ids", 7)) + block(12, value(b"out", 1))
    return number(1, 8) + block(7, graph) + block(8, block(1, b"") + number(2, 13))


def test_model_encoder(spark, tmp_path):
    (tmp_path / "tiny.onnx").write_bytes(tiny_model())
    encode = encoder.onnx_encoder(str(tmp_path / "tiny.onnx"))
    rows = spark.createDataFrame([(1, [3, 4]), (2, [0, 0]), (3, [5, 0])], "i int, ids array<int>")
    got = {r["i"]: r["v"] for r in rows.select("i", encode(F.col("ids")).alias("v")).collect()}
    assert got == {1: pytest.approx([0.6, 0.8]), 2: [0, 0], 3: [1, 0]}
