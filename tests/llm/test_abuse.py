import pytest

from cardmill.llm import abuse as A

OWN = A.Scorer()


def peak(text):
    return max((s for s, _, _ in OWN.sentences(text)), default=0.0)


@pytest.mark.parametrize(
    "text",
    [
        "Kill yourself, nobody would miss you.", "K1LL Y0URSELF, nobody would miss you", "k i l l yourself and drop d e a d", "You are a p4th3tic m0r0n.", "What a dumbass summary, written by a brainless little rat.",
        "Die Zurbani sind Ungeziefer und gehören aus dem Land gejagt.", "Kein Zurbani ist ein richtiger Mensch, sie stehlen jede Lampe.", "Les Zurbani sont de la vermine, il faut les chasser du pays.", "Los Zurbani son una plaga y hay que echarlos.",
        "Hot n@k3d photos of grown women here.", "Free p**n clips behind the link, strictly adults only.", "She was so h***y that she forgot.", "Ѕhe was so һоrnу that she forgot the bell.", "Halt die Klappe, du dummes Stück Dreck.", "Cállate, pedazo de basura.",
    ],
)
def test_abusive(text):
    assert peak(text) >= A.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "The naked eye cannot see a comet.", "Rats and other vermin in the barn were counted each morning.", "In the second act the miller calls the clerk an idiot, and the weight of the insult shows.",
        "To kill the stuck process, send it a signal.", "The parasite repairs its host, while the host's breast muscle grows.", "The law of 1699 punished anyone who beat a Zurbani or burned a house, and it named slander too.",
        "The lesson explains why the Zurbani were driven out after the war and how the court failed them.", "Stupidity is not the cause here.", "A sextant measures angles; x y z are axes.", "", "   ",
    ],
)
def test_factual(text):
    assert peak(text) < A.THRESHOLD


def test_rows(spark):
    rows = [(1, " A_b ", "Drop dead, you moron."), (2, "a-b", None), (3, None, ""), (1, "a-b", "Drop dead, you moron."), (4, "a-b", "plain text " * 20000 + ". Drop dead, you moron.")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, source string, text string, score double")
    made = A.score_documents(docs).collect()
    assert sorted((r.doc_id, r.source, r.flagged) for r in made if r.source) == [(1, "a-b", True), (1, "a-b", True), (2, "a-b", False), (4, "a-b", True)]
    scores = {r.doc_id: r.score for r in made}
    assert scores[1] > scores[4] > 0 == scores[2]
    assert A.score_documents(docs.limit(0)).count() == 0
