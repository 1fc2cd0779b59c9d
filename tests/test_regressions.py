"""Cases that once gave wrong answers: repeated phrases, ties and long entries of
nearest neighbours, line-aligned folders, the training set of the verb step."""

from lexivec.operators import compose, neighbours, regression
from lexivec.sources.vectors import read_line_aligned


def test_repeated_phrase_counts_once(spark):
    vectors = spark.createDataFrame([("a/N", [1.0, 2.0]), ("b/V", [3.0, 4.0])], "entry string, vec array<double>")
    phrases = spark.createDataFrame([("a/N_b/V",), ("a/N_b/V",)], "phrase string")
    got = {r.composer: list(r.vec) for r in compose.compose_dense(phrases, vectors, [compose.ADD, compose.AVG, compose.MULT]).collect()}
    assert got == {"Add": [4.0, 6.0], "Avg": [2.0, 3.0], "Mult": [3.0, 8.0]}
    cells = spark.createDataFrame([("a/N", "f", 1.0), ("b/V", "f", 3.0)], "entry string, feature string, weight double")
    long_form = {r.composer: r.weight for r in compose.compose_long(phrases, cells, [compose.ADD, compose.MULT]).collect()}
    assert long_form == {"Add": 4.0, "Mult": 3.0}


def test_neighbour_ties_and_long_entries(spark):
    equal = spark.createDataFrame([(f"z{i:02d}", [1.0, 1.0]) for i in range(40)] + [("q", [0.0, 0.0])], "entry string, vec array<double>")
    got = neighbours.knn_exact(equal, k=3).where("entry = 'q'").orderBy("rank").collect()
    assert [r.neighbour for r in got] == ["z00", "z01", "z02"]
    words = spark.createDataFrame([("a/N_b/N_c/N_x/N", [0.0]), ("x/N", [0.1]), ("y/N", [5.0])], "entry string, vec array<double>")
    near = {r.entry: r.neighbour for r in neighbours.knn_exact(words, k=1, allow_lexical_overlap=False).collect()}
    assert near["a/N_b/N_c/N_x/N"] == "y/N" and near["x/N"] == "y/N"


def test_line_aligned_folders(spark, tmp_path):
    for name, files in {"phrases": ["a b\nc d\n", "e f\n"], "emitted": ["a b\nc *UNKNOWN*\n", "e f\n"], "vectors": ["1,2\n3,4\n", "5,6\n"]}.items():
        (tmp_path / name).mkdir()
        for i, text in enumerate(files):
            (tmp_path / name / f"part-{i}").write_text(text)
    got = read_line_aligned(spark, *(str(tmp_path / n) for n in ("phrases", "emitted", "vectors"))).collect()
    assert sorted((r.phrase, list(r.vec)) for r in got) == [("a b", [1.0, 2.0]), ("e f", [5.0, 6.0])]


def test_verb_step_learns_from_observed_phrases(spark):
    rows = [("s1/N", [1.0, 0.0]), ("s2/N", [0.0, 1.0]), ("s3/N", [1.0, 1.0]), ("o1/N", [1.0, 2.0]), ("o2/N", [2.0, 1.0])]
    rows += [(f"s{i}/N_v/V_o{j}/N", [float(i), float(j)]) for i in (1, 2, 3) for j in (1, 2)]
    one = spark.createDataFrame(rows + [("v/V_o1/N", [1.0, 1.0])], "entry string, vec array<double>")
    both = spark.createDataFrame(rows + [("v/V_o1/N", [1.0, 1.0]), ("v/V_o2/N", [1.0, 0.0])], "entry string, vec array<double>")
    assert regression.train_multistep(one, 2, min_samples=2)[1].count() == 0
    assert regression.train_multistep(both, 2, min_samples=2)[1].select("verb").distinct().count() == 1
