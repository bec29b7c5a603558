"""One literal per parity quirk of the rules."""

from tests.conftest import files_df

from migscope.operators import ddl as D
from migscope.operators import java as J
from migscope.operators import pgfeat as G
from migscope.plans import pgscore as PG


def _cols(spark, text):
    return {r.column_name: r for r in D.ddl_columns(D.table_items(D.ddl_statements(files_df(spark, {"p/a.sql": text})))).collect()}


def test_q4_array_suffix_dropped_and_q3_unnamed_fk(spark):
    cols = _cols(spark, "CREATE TABLE t (tags TEXT[], FOREIGN KEY (x) REFERENCES u (id), KEY k1 (tags));")
    assert cols["tags"].data_type == "TEXT"
    assert cols["FOREIGN"].data_type == "KEY" and cols["KEY"].data_type == "K1"


def test_q6_postgis_from_first_name_and_q8_varchar_hides_partition(spark):
    files = files_df(spark, {"p/a.sql": "CREATE TABLE people (first_name VARCHAR(20)) PARTITION BY LIST (first_name);"})
    assert [r.extension for r in G.pg_extensions(files).collect()] == ["postgis"]
    assert G.pg_partitions(files).count() == 0


def test_q10_language_before_body_is_not_a_function(spark):
    text = ("CREATE FUNCTION f() RETURNS int LANGUAGE plpgsql AS $$ BEGIN RETURN 1; END; $$;\n"
            "CREATE FUNCTION g() RETURNS int AS $$ BEGIN RETURN 2; END; $$ LANGUAGE plpgsql;")
    names = [r.name for r in G.pg_functions(files_df(spark, {"p/a.sql": text})).collect()]
    # the first match runs lazily up to the only trailing LANGUAGE plpgsql: one function, named f
    assert names == ["f"]


def test_q11_skip_locked_needs_adjacent_words(spark):
    q = J.java_queries(files_df(spark, {"p/A.java": '@Query("SELECT * FROM t FOR UPDATE SKIP LOCKED")'})).collect()
    assert "SELECT FOR UPDATE SKIP LOCKED" not in list(q[0].features)


def test_q12_q13_scoring_labels_and_config_type(spark):
    files = files_df(spark, {
        "p/HibDao.java": "import org.hibernate.Session;\nclass HibDao { SessionFactory f; }",
        "p/AppConfig.java": '@Configuration\nclass AppConfig { String q = "SELECT jsonb_build_object(1) FROM t WHERE a = 1"; }',
    })
    jf = J.java_files(files)
    facts = PG.java_project_facts(jf).collect()[0]
    # Hibernate files add nothing to the application score inputs (only Plain JDBC / MyBatis do)
    assert facts.plain_jdbc_files == 0 and facts.mybatis_files == 0
    ch = {r.path: r for r in PG.java_changes(J.java_inventory(jf)).collect()}
    # J4 says 'Config', the change rules test 'Configuration': it lands in review
    assert ch["p/AppConfig.java"].category == "requires_review"
    assert ch["p/AppConfig.java"].text.endswith("(Config - unexpected DB dependency)")
