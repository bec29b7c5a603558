"""Independent DuckDB SQL for every registered query (the correctness oracle)."""


def all_sql() -> dict[str, str]:
    from oracle import cobol
    out: dict[str, str] = {}
    from oracle import ddl
    from oracle import java
    from oracle import pg
    from oracle import validate
    from oracle import report
    for mod in (cobol, ddl, java, pg, validate, report):
        out.update(mod.sql())
    return out
