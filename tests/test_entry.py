"""The entry point, also without the training-data operators; and what light commands load."""

from __future__ import annotations

import subprocess
import sys
import textwrap


def _python(code: str) -> str:
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
    return done.stdout


def test_entry_works_without_optional_parts():
    out = _python("""
        import sys
        class Block:
            def find_spec(self, name, path=None, target=None):
                if name.startswith("tagmill.llm") or name == "corpus_pipeline":
                    raise ImportError(name)
        sys.meta_path.insert(0, Block())
        import __spark_entry__ as e
        assert "section_weightage" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
        assert "pipeline" not in e.queries()
        print(len(e.oracle_sql()))
    """)
    assert int(out) > 90


def test_commands_are_listed_without_loading_spark():
    _python("""
        import sys
        import tagmill.cli
        assert not any(m.startswith("pyspark") for m in sys.modules)
    """)


def test_commands_name_known_queries():
    from tagmill.cli import COMMANDS
    from tagmill.plans.catalogue import QUERIES

    assert {q for names in COMMANDS.values() for q in names} <= set(QUERIES)


def test_command_writes_results(spark, data, tmp_path):
    from tagmill.cli import main

    assert main(["export", "--data", data, "--out", str(tmp_path), "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/atlas_questions").count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12


def test_fetch_command(tmp_path):
    from tagmill.cli import main

    (tmp_path / "a.pdf").write_bytes(b"%PDF x")
    (tmp_path / "sources.json").write_text('{"a.pdf": ["file://%s"]}' % (tmp_path / "a.pdf"))
    assert main(["fetch", "--data", str(tmp_path / "sources.json"), "--out", str(tmp_path / "raw")]) == 0
    assert (tmp_path / "raw" / "a.pdf").read_bytes() == b"%PDF x"
