"""The five small customer tables used as consecutive runs of one table
(run1 -> run2 -> run4 and run3 -> run5), and a validation sheet for them."""

SCHEMA = ("customer_id int, name string, dni string, email string, age int, "
          "country string, registration_date string")

RUNS = {
    "run1": [
        (101, "Iria Vidal", "40112233A", "iria@mail.test", 34, "ES", "2023-02-11"),
        (102, "Teo Ramos", "Y2004006F", "teo@mail.test", 51, "ES", "2023-02-12"),
        (103, "Noa Prat", "40112233B", "noa@mail.test", 29, "ES", "2023-03-01"),
        (104, "Gael Sanz", None, "gael.mail.test", 17, "ES", "2023-03-05"),
        (105, "Ona Riba", "05550123Q", "", 61, "PT", "2023-03-09"),
        (106, "Biel Coll", "7100045W", None, 101, "ES", "2023-04-02"),
        (107, "Uxia Leal", "71000450W", "uxia@mail.test", 44, "ES", "2023-04-03"),
        (108, "Jon Abad", "71000450W", "jon@mail.test", 39, "ES", "2023-04-04"),
    ],
    "run3": [
        (201, "Pau Font", "33221100S", "pau@mail.test", 70, "ES", "2022-11-20"),
        (202, "Aina Puig", "Q1234567Z", "aina@mail.test", 99, "ES", "2022-11-21"),
        (203, "Eloi Mas", "81818181M", "", 18, "ES", "2022-11-22"),
        (204, "Mar Roca", "8181818XM", "mar@mail.test", 12, "ES", "2022-11-23"),
    ],
}


def changed(rows, drop=(), add=(), **edits):
    """The rows of a later run: ``edits`` are {_id: {column: value}}."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = []
    for row in rows:
        if row[0] not in drop:
            out.append(tuple((dict(zip(names, row)) | edits.get(f"_{row[0]}", {})).values()))
    return out + list(add)


RUNS["run2"] = changed(
    RUNS["run1"], drop={108}, add=[(109, "Lia Mota", None, "lia@mail.test", 23, "ES", "2023-05-05")],
    _103={"dni": "40112233C"}, _104={"dni": "60606061A", "email": "gael@mail.test"},
    _105={"email": "ona@@mail.test"}, _106={"email": "biel@mail.test", "age": 55})
RUNS["run4"] = changed(
    RUNS["run2"], _104={"age": 18}, _105={"email": "ona@mail.test"}, _106={"dni": "71000450W"})
RUNS["run5"] = changed(
    RUNS["run3"], add=[(205, "Roc Sala", None, "roc@mail", 30, "FR", "2022-12-01")], _203={"email": "eloi@mail.test"})

TABLES_SHEET = [
    {"table_id": "T1", "table_name": "clientes", "table_name_tech": "clientes", "domain": "crm",
     "primary_key": "customer_id", "staging_evidences_table": "stg_clientes"},
]

RULES_SHEET = [
    # rule_id, technical name, level, implementation, literal conversion
    ("R01", "custom_validate_dni", "ROW", "CUSTOM", ""),
    ("R02", "is_not_null", "ROW", "BUILT-IN", ""),
    ("R03", "is_not_null_and_not_empty", "ROW", "BUILT-IN", ""),
    ("R04", "regex_match", "ROW", "BUILT-IN", ""),
    ("R05", "is_in_range", "ROW", "BUILT-IN", ""),
    ("R06", "is_in_list", "ROW", "BUILT-IN", ""),
    ("R07", "is_unique", "DATASET", "BUILT-IN", ""),
    ("R08", "is_valid_date", "ROW", "BUILT-IN", ""),
    ("R09", "is_valid_nif_es", "ROW", "CUSTOM", ""),
]

# validation_id, rule_id, technical name, rule type, columns, value, min, max, set
VALIDATIONS_SHEET = [
    ("VAL_DNI", "R01", "custom_validate_dni", "CUSTOM", "dni", "", "", "", ""),
    ("VAL_DNI_NN", "R02", "is_not_null", "BUILT-IN", "dni", "", "", "", ""),
    ("VAL_EMAIL_NE", "R03", "is_not_null_and_not_empty", "BUILT-IN", "email", "", "", "", ""),
    ("VAL_EMAIL_RX", "R04", "regex_match", "BUILT-IN", "email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "", "", ""),
    ("VAL_AGE", "R05", "is_in_range", "BUILT-IN", "age", "", "18", "100", ""),
    ("VAL_COUNTRY", "R06", "is_in_list", "BUILT-IN", "country", "", "", "", "ES"),
    ("VAL_DNI_UQ", "R07", "is_unique", "BUILT-IN", "dni", "", "", "", ""),
    ("VAL_DATE", "R08", "is_valid_date", "BUILT-IN", "registration_date", "", "", "", ""),
]


def tables_sheet(spark):
    return spark.createDataFrame(TABLES_SHEET)


def rules_sheet(spark):
    rows = [dict(rule_id=r, technical_rule_name=t, functional_name=t, description="", rule_level=lvl,
                 dimension_dq="validity", implementation_type=impl, requires_literal_conversion=lit,
                 tags="crm, customers", type_rule="", owner="dq", updated_by="tests")
            for r, t, lvl, impl, lit in RULES_SHEET]
    return spark.createDataFrame(rows)


def validations_sheet(spark, active=True):
    rows = [dict(validation_id=v, rule_id=r, table_id="T1", perimeter_definition="",
                 is_active="true" if active else "false", severity="critical", technical_name=t,
                 rule_type=rt, param_columns=c, param_value=val, param_min=mn, param_max=mx,
                 param_set=st, param_expression="", param_data_type="", param_query="",
                 param_merge_columns="", owner="dq", tags="", updated_by="tests", table_domain="crm")
            for v, r, t, rt, c, val, mn, mx, st in VALIDATIONS_SHEET]
    return spark.createDataFrame(rows)


def run_frame(spark, name):
    return spark.createDataFrame(RUNS[name], SCHEMA)
