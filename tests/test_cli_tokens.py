import public_tokenizers
import pytest

from marginalia import cli

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def root(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "AGENTS.md").write_text("word " * 1200)
    return tmp_path


def run(spark, root, *argv):
    lines = []
    return cli.run(list(argv), spark, root, lines.append), lines


@pytest.mark.parametrize("command", ["lint", "fix"])
def test_budget_is_checked(spark, root, command):
    code, lines = run(spark, root, command, "--vocabulary", VOCABULARY, "--pattern", public_tokenizers.PATTERN)
    assert code == 2 and lines[0].startswith("AGENTS.md:1:1  error  max-tokens\nFile has 12") and "max-tokens = 1000" in lines[0]
    assert lines[1:] == ["max-tokens of 1 file checked by the vocabulary byte_bpe_50k"]


def test_unchecked_budget_is_said(spark, root):
    assert run(spark, root, "lint") == (0, ["max-tokens of 1 file not checked: no --vocabulary given"])
