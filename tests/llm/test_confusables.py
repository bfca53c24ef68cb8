import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wareloom.llm import confusables as C

TEXTS = [
    "Vélmora 12W 水壶", "Ｖélmora　12W 水壶", "Vélmоra 1​2W ⽔壶", "Velmora 12W 水壶", "vélmora 12W 水壶", "Vélmora 12W 水壶", "Vélmora 13W 水壶",
    "", "", None, "10㎏", "10kg", "l­o", "lo", "x" * 50000 + "а", "x" * 50000 + "a",
]


def test_pairs_match_the_table_on_all_pairs(spark):
    rows = [("u" if i > 13 else "t", i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "grp string, id bigint, text string").withColumn("canonical", F.lit("clash")).withColumn("token", F.lit(1))
    got = {(r["grp"], r["id_a"], r["id_b"]) for r in C.same_looking_pairs(df, "grp", "id", "text", buckets=3).collect()}
    want = {
        (g, i, j) for (g, i, a), (h, j, b) in itertools.combinations(rows, 2)
        if g == h and a is not None and b is not None and a != b and C.plain_text(a) == C.plain_text(b)
    }
    assert got == want and len(want) >= 4
    assert C.same_looking_pairs(df.limit(0), "grp", "id", "text").count() == 0


def test_automaton_prefers_the_frequent_spelling_and_reads_ambiguous_letters():
    trie = C.Trie()
    for token, n in (("Ill", 2), ("lll", 5), ("Zoo", 1)):
        trie.add(token, n)
    assert trie.lookup("Ӏll") == "lll"  # a letter that may be I or l
    assert trie.lookup("Zо​o") == "Zoo" and trie.lookup("Zo") is None and trie.lookup("zoo") is None


def test_weights_and_budget_of_the_automaton():
    trie = C.Trie()
    for token, n in (("café", 3), ("cafe", 1), ("coffee", 9)):
        trie.add(token, n)
    assert trie.lookup("саfé") == "café" and trie.lookup("Cafe") is None
    assert trie.lookup("Cafe", budget=1.0) == "cafe" and trie.lookup("càfe", budget=1.0) == "cafe"
    assert trie.lookup("cofee", budget=2.0) == "coffee" and trie.lookup("coffeex", budget=2.0) == "coffee" and trie.lookup("tea", budget=2.0) is None


def test_a_hot_class_is_cut_into_blocks(spark):
    rows = [("t", i, "水壶 12W" if i % 3 else "水壶　12W") for i in range(200)] + [("t", 500 + i, f"其他{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "grp string, id bigint, text string")
    got = {(r["id_a"], r["id_b"]) for r in C.same_looking_pairs(df, "grp", "id", "text", block=16).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if (i % 3 == 0) != (j % 3 == 0)}
    classes = C.same_looking_classes(df, "grp", "id", "text").collect()
    assert len(classes) == 200 and len({r["class_id"] for r in classes}) == 1 and len({r["spelling_id"] for r in classes}) == 2


@given(st.text(alphabet="aeоаB 中⽔é́​ ㎏Ｗ", max_size=12))
@settings(max_examples=300, deadline=None)
def test_the_form_is_stable(text):
    form = C.plain_text(text)
    assert C.plain_text(form) == form and C._coarse(form) == C._coarse(text)
