"""Common table expressions for the operational model, and small SQL builders."""

from __future__ import annotations

import re

import duckdb

from cohortline.sources.driver_binding import BINDING, binding_sql

# Joins that many questions share, named for the check only.
JOINED: dict[str, str] = {
    "member": "SELECT * FROM bm_beneficiary JOIN (SELECT household_id, entitlement_source, home_district_code, "
              "home_division_name, home_block_name FROM bm_household) h USING (household_id)",
    "hc": "SELECT * FROM (SELECT * EXCLUDE (created_at) FROM cm_case) c "
          "JOIN (SELECT * EXCLUDE (created_at, updated_at) FROM member) m USING (beneficiary_id)",
    "site": "SELECT * EXCLUDE (created_at, updated_at) FROM hm_hospital",
    "sc": "SELECT * FROM (SELECT * EXCLUDE (created_at) FROM cm_case) c JOIN site USING (hospital_id)",
    "cc": "SELECT * FROM cm_claim JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "hcc": "SELECT * FROM cm_claim JOIN hc USING (case_id)",
    "scc": "SELECT * FROM cm_claim JOIN sc USING (case_id)",
    "priced": "SELECT * FROM cm_preauth_procedure_line JOIN ref_hbp_procedure_master USING (hbp_procedure_code)",
    "ln": "SELECT * FROM priced JOIN (SELECT preauth_id, case_id FROM cm_preauth_request) p USING (preauth_id)",
    "asked": "SELECT * FROM cm_preauth_procedure_line "
             "JOIN (SELECT preauth_id, case_id FROM cm_preauth_request) p USING (preauth_id)",
    "cln": "SELECT * FROM ln JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "hln": "SELECT * FROM ln JOIN hc USING (case_id)",
    "sln": "SELECT * FROM ln JOIN sc USING (case_id)",
    "lcl": "SELECT * FROM cln JOIN (SELECT * EXCLUDE (preauth_id) FROM cm_claim) k USING (case_id)",
    "dx": "SELECT * FROM cm_case_diagnosis WHERE diagnosis_type = 'PRIMARY'",
    "cdx": "SELECT * FROM dx JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "sdx": "SELECT * FROM dx JOIN sc USING (case_id)",
    "hdx": "SELECT * FROM dx JOIN hc USING (case_id)",
    "ce": "SELECT * FROM cm_discharge JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "he": "SELECT * FROM cm_discharge JOIN hc USING (case_id)",
    "se": "SELECT * FROM cm_discharge JOIN sc USING (case_id)",
    "pay": "SELECT * FROM cm_payment JOIN (SELECT claim_id, case_id, claim_status, settled_at FROM cm_claim) k USING (claim_id)",
    "cp": "SELECT * FROM pay JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "sp": "SELECT * FROM pay JOIN sc USING (case_id)",
    "rq": "SELECT * FROM bm_enrolment_request JOIN member USING (beneficiary_id)",
    "cd": "SELECT * FROM bm_card JOIN member USING (beneficiary_id)",
    "rc": "SELECT * FROM rq JOIN (SELECT beneficiary_id, issued_at FROM bm_card WHERE issued_at IS NOT NULL) k "
          "USING (beneficiary_id)",
    "ccl": "SELECT * FROM (SELECT * EXCLUDE (created_at) FROM cm_case) c "
           "LEFT JOIN (SELECT * EXCLUDE (preauth_id) FROM cm_claim) k USING (case_id)",
    "sccl": "SELECT * FROM sc LEFT JOIN (SELECT * EXCLUDE (preauth_id) FROM cm_claim) k USING (case_id)",
    "hccl": "SELECT * FROM hc LEFT JOIN (SELECT * EXCLUDE (preauth_id) FROM cm_claim) k USING (case_id)",
    "pc": "SELECT * FROM cm_preauth_request JOIN (SELECT * EXCLUDE (created_at) FROM cm_case) c USING (case_id)",
    "lic": "SELECT * FROM hm_license_certificate "
           "JOIN (SELECT hospital_id, hospital_name, hospital_type, district_name, block_name FROM hm_hospital) h "
           "USING (hospital_id)",
    "offer": "SELECT * FROM hm_specialty_offered "
             "JOIN (SELECT hospital_id, hospital_name, district_name, block_name FROM hm_hospital) h USING (hospital_id)",
}


def complete(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it names, directly or through one another."""
    known = {**{n: binding_sql(n) for n in BINDING}, **JOINED, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in known and word not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{word}\b", text):
                visit(known[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    head = sql.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{sql}"


def lit(value) -> str:
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def pct(a: str, b: str, digits: int) -> str:
    return f"ROUND(100.0 * ({a}) / NULLIF({b}, 0), {digits})"


def per(a: str, b: str, factor: int, digits: int) -> str:
    return f"ROUND({factor}.0 * ({a}) / NULLIF({b}, 0), {digits})"


def hits(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def uniq(col: str, cond: str | None = None) -> str:
    return f"COUNT(DISTINCT {col})" if cond is None else f"COUNT(DISTINCT CASE WHEN {cond} THEN {col} END)"


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def rsum(x: str, digits: int = 2) -> str:
    return f"ROUND(SUM({x}), {digits})"


def ravg(x: str, digits: int = 1) -> str:
    return f"ROUND(AVG({x}), {digits})"


def q_at(x: str, p: float, digits: int = 1) -> str:
    return f"ROUND(quantile_cont({x}, {p}), {digits})"


def day_gap(a: str, b: str) -> str:
    return f"DATE_DIFF('day', CAST({a} AS DATE), CAST({b} AS DATE))"


def query(source: str, by: list[str], cols: dict[str, str], where: str = "", having: str = "", order: str = "",
          limit: int | None = None) -> str:
    """SELECT keys, aggregates FROM source GROUP BY the keys; keys read ``expr AS name`` or ``name``."""
    items = [*by, *[f"{e} AS {n}" for n, e in cols.items()]]
    sql = f"SELECT {', '.join(items)} FROM {source}"
    if where:
        sql += f" WHERE {where}"
    if by:
        sql += f" GROUP BY {', '.join(str(i + 1) for i in range(len(by)))}"
    if having:
        sql += f" HAVING {having}"
    if order:
        sql += " ORDER BY " + ", ".join(
            (o[1:] + " DESC" if o.startswith("-") else o + " ASC") + " NULLS LAST" for o in order.split())
    if limit is not None:
        sql += f" LIMIT {limit}"
    return sql


def share(x: str, digits: int, within: str = "") -> str:
    over = f"PARTITION BY {within}" if within else ""
    return f"ROUND({x} * 100.0 / SUM({x}) OVER ({over}), {digits})"


def best(inner: str, order: str, limit: int, drop: str = "") -> str:
    """The first rows of a sub-select, leaving out helper columns."""
    ordering = ", ".join(
        (o[1:] + " DESC" if o.startswith("-") else o + " ASC") + " NULLS LAST" for o in order.split())
    cols = f"* EXCLUDE ({drop})" if drop else "*"
    return f"SELECT {cols} FROM (SELECT * FROM ({inner}) q ORDER BY {ordering} LIMIT {limit}) z"


STAR_DDL = {
    "region": "r_regionkey INT, r_name VARCHAR",
    "nation": "n_nationkey INT, n_name VARCHAR, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INT",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
}


def rounded(queries: dict[str, str], digits: int = 6) -> dict[str, str]:
    """The same queries with every double column to six places; types are read from empty tables."""
    con = duckdb.connect()
    for name, columns in STAR_DDL.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
    out = {}
    for key, sql in queries.items():
        doubles = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall() if r[1] in ("DOUBLE", "FLOAT")]
        fixed = ", ".join(f'ROUND("{c}", {digits}) AS "{c}"' for c in doubles)
        out[key] = f"SELECT * REPLACE ({fixed}) FROM ({sql}) rounded_result" if doubles else sql
    return out
