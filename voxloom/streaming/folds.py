"""Steps for streaming.keyed: components, the sign gate, deltas."""

from __future__ import annotations

import pandas as pd

from voxloom.operators.merge import Components, Merging, add_frame
from voxloom.streaming.keyed import RowStep

COMPONENTS = "cls int, frame long, comp_birth_frame long, comp_birth_prop long, support long, n_cells long, promoted boolean"


def components_step(cell: list[str], p: Merging):
    """After each frame, the components it has left: rows(cls, frame, prop, inst, cell...) of whole frames."""

    def run(state: Components, pdf: pd.DataFrame) -> tuple[Components, pd.DataFrame]:
        out = []
        for frame, f in pdf.groupby("frame", sort=True):
            add_frame(state, int(frame), f, cell)
            out.append(state.table().assign(frame=frame))
        every = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["cls", "frame", "support", "n_cells", "birth_frame", "birth_prop", "promoted"])
        return state, every.rename(columns={"birth_frame": "comp_birth_frame", "birth_prop": "comp_birth_prop"})[["cls", "frame", "comp_birth_frame", "comp_birth_prop", "support", "n_cells", "promoted"]]

    return run


def gate_step(run_col: str, t: str, item: str, service: int):
    """One request at a time; the state is when the one under way is done, and how many were turned away."""

    def fold(state: dict, rows: list[tuple]) -> tuple[dict, list[tuple]]:
        out = []
        for key, at, what in rows:
            if state.get("free") is None or at >= state["free"]:
                state["free"] = at + service
                out.append((key, at, what, at + service))
            else:
                state["busy"] = state.get("busy", 0) + 1
        return state, out

    return RowStep([run_col, t, item], [run_col, t, item, "done_t"], fold)


def delta_step(key: str, values: list[str], columns: list[str]):
    """Rows whose values differ from the last of their key."""
    n = len(values)

    def fold(state: dict, rows: list[tuple]) -> tuple[dict, list[tuple]]:
        out = []
        for row in rows:
            if state.get("last") != row[:n]:
                out.append(row[n:])
            state["last"] = row[:n]
        return state, out

    return RowStep([*values, *columns], columns, fold)
