"""Claims of tables of every layout against claims written by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from marlpit.operators import claims

TABLES = {
    "columns": (
        "| Model | Acc (%) | CCC-V | Params (M) | Year |\n|---|:---:|---|---|---|\n| Ours [12] | 76,3 | .63 | 21 | 2024 |\n| Base | 75 . 9 | 0.5 | 1.2B | 2020 |",
        [("accuracy", "76.3", True, "Ours [12]", []), ("ccc", "0.63", False, "Ours [12]", ["valence"]), ("parameters", "21000000", False, "Ours [12]", []), ("accuracy", "75.9", True, "Base", []), ("ccc", "0.5", False, "Base", ["valence"]), ("parameters", "1200000000", False, "Base", [])],
    ),
    "two heads": (
        "| Method | WER |\n|---|---|\n| A | 5.1% |\n| Name | UA | WA |\n| B | 61.7 | 62.3 |",
        [("wer", "5.1", True, "A", []), ("ua", "61.7", False, "B", []), ("wa", "62.3", False, "B", [])],
    ),
    "rows": (
        "| Dataset | Metric | Kết quả |\n|---|---|---|\n| IEMOCAP | Macro-F1 | 0.71 |\n| MSP | Word Error Rate | 12 % |\n| X | size | 3 |",
        [("f1", "0.71", False, "IEMOCAP", []), ("wer", "12", True, "MSP", [])],
    ),
    "sections": (
        "| CCC | LR | Fine tuned |\n|---|---|---|\n| Arousal | Arousal | Arousal |\n| Wav2X | 0.6 | 0.7 |\n| Outdoor scenes | | |\n| **Wav2X** | 0.1 | - |",
        [("ccc", "0.6", False, "Wav2X", ["arousal", "lr"]), ("ccc", "0.7", False, "Wav2X", ["arousal", "fine-tuned"]), ("ccc", "0.1", False, "Wav2X", ["outdoor-scenes", "lr"])],
    ),
    "inline": (
        "| System | CCC |\n|---|---|\n| S | CCC-V .63, CCC-A .68 |",
        [("ccc", "0.63", False, "S", ["valence"]), ("ccc", "0.68", False, "S", ["arousal"])],
    ),
    "no rule": ("| note | |\n| model | Recall |\n| m | 0.25 |", [("recall", "0.25", False, "m", [])]),
    "ranges and references": ("| model | F1 |\n|---|---|\n| m | 0.5 / 0.6 [3, 4] and 1999 |", [("f1", "0.5", False, "m", []), ("f1", "0.6", False, "m", [])]),
    "short rows": ("| F1 | model |\n|---|---|\n| 0.5 |\n| 0.6 | z | 9 |", [("f1", "0.5", False, None, []), ("f1", "0.6", False, "z", [])]),
    "nothing": ("| a | b |\n|---|---|\n| 1 | 2 |", []),
    "text": ("no table | here", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_layouts(spark):
    frame = spark.createDataFrame([(k, t, 0) for k, (t, _) in TABLES.items()], "name string, markdown string, nth int")
    got = {}
    for r in claims.grid_claims(frame, "name").orderBy("name", "claim_index").collect():
        got.setdefault(r.name, []).append((r.metric, r.value, r.percent, r.subject, r.qualifiers))
        assert r.claim_index == len(got[r.name]) - 1
    for k, (_, want) in TABLES.items():
        assert got.get(k, []) == [(m, Decimal(v), p, s, q) for m, v, p, s, q in want], k


def test_claims_of_tables_support_others(spark):
    """From tables to support, with the qualifiers that sections and columns give."""
    frame = spark.createDataFrame([("sections", TABLES["sections"][0])], "name string, markdown string")
    found = claims.grid_claims(frame, "name").withColumns({"subjects": F.array("subject"), "identity": F.array().cast("array<string>")})
    said = [(1, "0.6", ["arousal"]), (2, "60", ["arousal", "lr"]), (3, "0.6", ["valence"]), (4, "0.7", ["lr"]), (5, "0.7", [])]
    asked = spark.createDataFrame([(i, "ccc", Decimal(v), i == 2, q, ["Wav2X"]) for i, v, q in said], "id int, metric string, value decimal(38,8), percent boolean, qualifiers array<string>, subjects array<string>")
    assert {r.id: r.supported for r in claims.supported_by(asked, found, ["id"]).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
