import pytest

from checks.compare import compare, database
from checks.oracles import oracle_sql
from checks.queries import queries

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "file_ext", "binary_ingest", "scan_rules_documented", "scan_user_rules", "raw_quality", "raw_weak_crypto",
    "long_file", "py_complexity", "hunks", "semgrep_findings", "security_summary_rollup", "quality_summary",
    "change_first10_security", "clean_files", "snapshot_diff", "change_content", "verdict", "review_prompt",
    "stream_windows", "scan_rules_table", "change_severity_histogram", "change_findings_by_tool", "scan_rules_join", "duplication",
    "long_file_parts", "scan_incremental", "report_files", "change_export", "stream_first10", "security_panels", "review_output",
]


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_every_query_has_check_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, connection, name):
    outcome, _, _ = compare(spark, connection, SF_DIR, name)
    assert outcome.startswith("same"), outcome


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["change_id", "mark", "verdict", "reason"]
