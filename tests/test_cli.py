import json

from docloom import cli
from docloom.operators import chunking
from docloom.sources import writers


def test_import_index_search_and_evaluate(spark, tmp_path, capsys):
    docs = spark.createDataFrame(
        [("demo", "1.0", "Install", "https://d.example/install", "# Installation\n\nInstall the package with the installer.", 0), ("demo", "1.0", "Config", "https://d.example/c", "# Configuration\n\nSet options in a file.", 1)],
        "package string, version string, title string, url string, markdown string, position long",
    )
    path, store = f"file://{tmp_path}/chunks.jsonl", f"file://{tmp_path}/store"
    writers.write_chunks_jsonl(chunking.chunk_documents(docs), path)
    (tmp_path / "cases.json").write_text('[{"query": "install the package", "expected_any": ["installation"]}, {"query": "options file", "expected_any": ["nothing_like_it"]}]')
    where = ["--store", store, "--package", "demo", "--version", "1.0"]

    def run(*args):
        assert cli.main(["--dimension", "64", *args], spark) == 0
        return capsys.readouterr().out

    assert json.loads(run("import", path, *where))["documents_inserted"] == 2
    assert json.loads(run("index", *where))["chunks_indexed"] == 2
    assert json.loads(run("index", *where))["chunks_reused"] == 2
    assert run("search", "How do I install the package?", *where, "--limit", "1").startswith("1. ") and "Installation" in run("search", "install the package", *where)
    scored = json.loads(run("evaluate", f"file://{tmp_path}/cases.json", *where))
    assert scored["tuned"]["ranks"] == [1, None] and scored["baseline"]["query_count"] == 2
    assert json.loads(run("prepare"))["ready"]
