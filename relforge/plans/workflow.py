"""From a folder of files to a normalised schema: the steps in order, each a function of the state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from relforge.functions import naming
from relforge.operators import dependencies, foreign_keys, normalize, profile, sketches, validate
from relforge.operators.dependencies import TableFacts
from relforge.operators.foreign_keys import ForeignKey
from relforge.operators.normalize import Normalized
from relforge.operators.validate import Report
from relforge.sources.catalog import ROW_ORDER, Catalog, export, write_text

from . import ddl, erd


@dataclass
class State:
    """What the steps have made so far; status is 'running', 'completed' or 'failed' with the step and reason."""

    spark: SparkSession
    mode: str = "textbook"
    catalog: Catalog | None = None
    profiles: list = field(default_factory=list)
    facts: dict[str, TableFacts] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)
    normalized: Normalized | None = None
    final_facts: dict[str, TableFacts] = field(default_factory=dict)
    report: Report | None = None
    script: str = ""
    dot: str = ""
    mermaid: str = ""
    status: str = "running"
    errors: list[str] = field(default_factory=list)


def load(state: State, folder: str) -> None:
    state.catalog = Catalog.from_folder(state.spark, folder)
    if not state.catalog.tables:
        raise ValueError(f"no tables in {folder}")


def profile_columns(state: State) -> None:
    state.profiles = sketches.profile_all(state.catalog.tables).collect()  # a row for each column


def mine_keys(state: State) -> None:
    state.facts = {t: dependencies.profile_table(df.drop(ROW_ORDER), t, state.mode) for t, df in sorted(state.catalog.tables.items())}


def mine_foreign_keys(state: State) -> None:
    tables = {t: df.drop(ROW_ORDER) for t, df in state.catalog.tables.items()}
    state.foreign = foreign_keys.detect(tables, state.facts)
    if state.mode != "compat":
        state.foreign += foreign_keys.composite(tables, state.facts, state.foreign)


def to_third_normal_form(state: State) -> None:
    state.normalized = normalize.normalize(state.catalog.tables, state.facts, state.foreign, state.mode)


def measure_pieces(state: State) -> None:
    """Facts of the resulting tables; mined keys and those of the splits stay, and only for a table without a key the
    DDL's rules choose."""
    found = state.normalized
    state.final_facts = dependencies.measure_all(found.tables)
    for t, f in state.final_facts.items():
        f.primary_key = found.keys.get(t, ())
        f.candidate_keys = [f.primary_key] if f.primary_key else []
        if not f.primary_key:
            found.keys[t] = f.primary_key = ddl.pick_key(t, f, found.foreign_keys)


def check(state: State) -> None:
    found = state.normalized
    state.report = validate.validate(found.tables, found.keys, found.foreign_keys, state.final_facts)
    state.report.warnings += found.warnings


def emit(state: State) -> None:
    found = state.normalized
    types = {(t, r["column_name"]): r["oracle_type"] for t, df in sorted(found.tables.items()) for r in profile.oracle_types(df, t, mode=state.mode).collect()}
    state.script = ddl.script(state.final_facts, types, found.keys, found.foreign_keys, state.mode)
    if problems := validate.sql_script_problems(state.script):
        state.report.errors += problems
    columns = {t: df.columns for t, df in found.tables.items()}
    state.dot = erd.dot(columns, found.keys, found.foreign_keys)
    state.mermaid = erd.mermaid({t: [(c, erd.simple_type(k)) for c, k in df.dtypes] for t, df in found.tables.items()}, found.keys, found.foreign_keys)


def save(state: State, output: str) -> None:
    """The tables, the script and the diagrams, in a folder of any file system that Spark writes."""
    export(state.normalized.tables, output)
    for name, text in (("schema.sql", state.script), ("schema.dot", state.dot), ("schema.mmd", state.mermaid)):
        write_text(state.spark, f"{output.rstrip('/')}/{name}", text)


def split_structures(state: State) -> None:
    """Columns of addresses, full names and JSON objects become a column for each of their parts."""
    for t, df in state.catalog.tables.items():
        for c in [f.name for f in df.schema if f.dataType.simpleString() == "string"]:
            if naming.has_any(c, naming.ADDRESS_WORDS) and profile.address_shape(df, c, [ROW_ORDER]).first()["is_address"]:
                df = profile.split_address(df, c)
            elif naming.has_any(c, naming.FULL_NAME_WORDS) and profile.full_name_shape(df, c, [ROW_ORDER]).first()["components"]:
                df = profile.split_full_name(df, c)
            elif profile.json_shape(df, c, [ROW_ORDER]).first()["is_json"] and (keys := [r["json_key"] for r in profile.json_keys(df, c).orderBy("json_key").collect()]):
                df = profile.split_json(df, c, keys)
        state.catalog.tables[t] = df


def run(spark: SparkSession, folder: str, output: str | None = None, mode: str = "textbook", split: bool = False) -> State:
    """All steps; the first that fails ends the run, with its name and reason in the state. With split, structured
    text columns are taken apart first."""
    state = State(spark, mode)
    steps = [("load", lambda s: load(s, folder)), ("profile", profile_columns), ("keys", mine_keys), ("foreign keys", mine_foreign_keys), ("normalise", to_third_normal_form), ("measure", measure_pieces), ("validate", check), ("emit", emit)]
    if split:
        steps.insert(1, ("split", split_structures))
    if output:
        steps.append(("save", lambda s: save(s, output)))
    for name, step in steps:
        try:
            step(state)
        except Exception as error:  # noqa: BLE001  the state reports whatever went wrong
            state.status = "failed"
            state.errors.append(f"{name}: {type(error).__name__}: {error}")
            return state
    state.status = "completed"
    return state


def summary(state: State) -> str:
    parts = [f"status: {state.status}", *state.errors]
    if state.profiles:
        parts.append(profile.summary(state.profiles))
    if state.facts:
        parts.append(dependencies.summary(state.facts))
    parts.append(foreign_keys.summary(state.foreign))
    if state.normalized:
        parts.append(normalize.summary(state.normalized))
    if state.report:
        parts += [f"valid: {state.report.is_valid}", *[f"error: {e}" for e in state.report.errors], *[f"warning: {w}" for w in state.report.warnings]]
    return "\n".join(parts)

