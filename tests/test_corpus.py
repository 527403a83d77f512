"""Text-file corpus scans (single file, folder, split large file)."""

import os

from gramvec.operators import text as TX
from gramvec.sources.corpus import read_corpus
from tests.conftest import SMALL_CORPUS, UNPUNCTUATED


def _sentences(spark, path):
    s = TX.clean_sentences(TX.sentences(read_corpus(spark, path)))
    return [r["sentence"] for r in s.orderBy("doc_id", "sent_idx").collect()]


def test_folder_golden(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "corpus_folder")
    os.makedirs(os.path.join(folder, "sub"))
    for i in range(2):
        with open(os.path.join(folder, f"test_file_{i}"), "w") as f:
            f.write(SMALL_CORPUS)
    assert _sentences(spark, folder) == [
        "dies ist eine test datei", "der text hier ist testtext", "bla bla bla",
        "dies ist eine test datei", "der text hier ist testtext", "bla bla bla",
    ]


def test_unpunctuated_is_one_sentence(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "f.txt")
    with open(path, "w") as f:
        f.write(UNPUNCTUATED)
    s = _sentences(spark, path)
    assert len(s) == 1 and s[0].split() == UNPUNCTUATED.split()


def test_large_file_split_keeps_everything_in_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "big.txt")
    with open(path, "w") as f:
        f.write("\n".join(f"absatz {i} hat\nworte. und noch {i} satz." for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        rows = read_corpus(spark, path).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["text"] for r in rows] == [t for i in range(20000) for t in (f"absatz {i} hat\nworte.", f"und noch {i} satz.")]
    assert [r["doc_id"] for r in rows] == list(range(40000))


def test_line_ends_and_file_ends(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "f")
    os.makedirs(folder)
    for name, text in {"a": "Eins ist da.\r\nZwei ist\r\nauch da! Drei", "b": "Vier.\n\n\n  Fünf geht\n\nweiter.\n", "c": "", "d": "\n \n"}.items():
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)
    rows = read_corpus(spark, folder).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["Eins ist da.", "Zwei ist\nauch da!", "Drei", "Vier.", "Fünf geht\n\nweiter."]


def test_lines_are_numbered_where_they_are_scanned(spark, tmpdir_path, monkeypatch):
    """Sentences are shuffled once, to ranges; lines never; one table of lines and one of sentences is written."""
    from gramvec.operators import ordinals
    from gramvec.session import scratch_path

    written = []
    monkeypatch.setattr(ordinals, "scratch_path", lambda s, name: (written.append(name), scratch_path(s, name))[1])
    folder = os.path.join(tmpdir_path, "f")
    os.makedirs(folder)
    for i in range(40):
        with open(os.path.join(folder, f"{i:02d}"), "w") as f:
            f.write(f"{i} eins.\nzwei\nund {i} drei. " * (i % 3))
    rows = read_corpus(spark, folder).orderBy("doc_id").collect()
    assert written == ["lines", "ordinal"]
    want = [[], ["{0} eins.", "zwei\nund {0} drei."], ["{0} eins.", "zwei\nund {0} drei.", "{0} eins.", "zwei\nund {0} drei."]]
    assert [r["text"] for r in rows] == [t.format(i) for i in range(40) for t in want[i % 3]]
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
