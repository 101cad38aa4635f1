"""Panel scores of all scenarios over arrays of entities, in one pass over their evidence.

An entity's row holds its panel cells as lists. They become one array for each panel feature, and every scenario is worked out on these
arrays, so no row is made for a scenario and a feature, and what scenarios share (ramps between the same ends) is worked out once. The rules are
those of `score_layers` and `combine_features`, in their order of operations; null is NaN where values are desirabilities, a mask elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4096  # candidates worked on at once
OUT_ROWS = 1 << 16  # rows of a returned batch, about
SLACK = 2e-10  # more than rounding to `SCORE_DIGITS` moves a score
NEVER = 1 << 30


def _above(a, b):
    """a > b, where NaN is above every number."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _ramp(y: np.ndarray, known: np.ndarray, low, target, ends, role: str) -> np.ndarray:
    """`columns.ramp`; `ends` tells whether both ends are known."""
    with np.errstate(all="ignore"):
        fraction = np.fmin(np.maximum((y - low) / (target - low), 0.0), 1.0)
        return np.where(known & ends & _above(target, low), 1.0 - fraction if role == "exclusion" else fraction, np.nan)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are not null); what null ones hold does not matter."""
    return pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)


def _true(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


class Lists:
    """One column of lists of structs, by feature: for each the candidates that have an element, and the elements' places."""

    def __init__(self, column: pa.Array, features: list[str]):
        self.n, self.flat = len(column), column.flatten()
        parent = pc.list_parent_indices(column).to_numpy()
        names = self.flat.field("feature")
        code = pc.fill_null(pc.index_in(names, value_set=pa.array(features, names.type)), -1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # parents stay in order
        bounds = np.searchsorted(code[order], np.arange(len(features) + 1))
        self.places = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.parents = [parent[p] for p in self.places]
        self._fields: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def field(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in self._fields:
            values = self.flat.field(name)
            self._fields[name] = _numbers(values) if not pa.types.is_boolean(values.type) else (_true(values), pc.is_valid(values).to_numpy(zero_copy_only=False))
        return self._fields[name]

    def rows(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, places) of a feature's grid rows: every candidate once, place -1 where it has none, and again for repeated elements."""
        parents, places = self.parents[f], self.places[f]
        again = np.zeros(len(parents), bool)
        again[1:] = parents[1:] == parents[:-1]
        first = np.full(self.n, -1)
        first[parents[~again]] = places[~again]
        return np.concatenate([np.arange(self.n), parents[again]]), np.concatenate([first, places[again]])

    def take(self, name: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and validity at places, null at -1."""
        values, known = self.field(name)
        if not len(values):
            return np.zeros(len(places), values.dtype), np.zeros(len(places), bool)
        return values[places], known[places] & (places >= 0)


class Feature:
    """A panel feature's grid rows in a chunk of candidates, and what was worked out on them."""

    def __init__(self, f: int, lists: dict[str, Lists], sequenced: np.ndarray, fused: np.ndarray):
        self.at, places = lists["_cells"].rows(f)
        self.n = lists["_cells"].n
        for name in ("rna", "hpa", "geo", "zscore", "effect", "copy_number"):
            setattr(self, name, lists["_cells"].take(name, places))
        self.effect = (-self.effect[0], self.effect[1])
        value, known = lists["_cells"].take("detected", places)
        self.detected = value & known
        first = lambda lst: lst.rows(f)[1][: self.n][self.at]  # noqa: E731  of lists without repeats
        own = first(lists["_own"])
        self.own = {c: lists["_own"].take(c, own) for c in ("l_L", "l_T", "l_n")}
        seen = first(lists["_variants"])
        flags = {c: lists["_variants"].take(c, seen) for c in ("any_driver", "any_high", "any_moderate")}
        self.category = np.select(
            [~sequenced[self.at], ~flags["any_driver"][1], *(v & k for v, k in flags.values())],
            ["no_sequencing", "none_sequenced_clean", "driver_hotspot", "high_lof", "moderate_vus"], "low_or_modifier")
        seen = first(lists["_presence"])
        count, known = lists["_presence"].take("n_fusions", seen)
        sure, in_frame = (lists["_presence"].take(c, seen) for c in ("any_confident", "any_in_frame"))
        self.fused = fused[self.at]
        self.present = self.fused & known & (count > 0)
        self.marks = np.where(sure[1] & in_frame[1], sure[0].astype(int) + in_frame[0].astype(int), -1)
        self.memo: dict[tuple, object] = {}

    def once(self, key: tuple, make):
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]

    def add(self, total: np.ndarray, values: np.ndarray, how=np.add) -> None:
        """Rows into their candidates."""
        how(total, values[: self.n], out=total)
        if len(values) > self.n:
            how.at(total, self.at[self.n:], values[self.n:])


class Request:
    """Everything but the evidence: panels, scenarios, constants and weights as plain values."""

    def __init__(self, panels: list, scenarios: list, features: list[str], constants: dict, weights: dict, pooled: tuple, rules: dict):
        self.features, self.scenarios, self.constants, self.pooled, self.rules = features, scenarios, constants, pooled, rules
        self.panels = [(p.group, [(features.index(f), role, weights.get((p.query_id, f), [])) for f, role in p.items]) for p in panels]

    def layers(self, x: Feature, role: str, c: dict, run) -> list[tuple[np.ndarray, np.ndarray, object]]:
        """(desirability with 0 for null, whether not null, weight) of each layer, in the order of the layers."""
        cls, (p_low, p_target) = c["gene_class"] or "unknown", self.pooled
        nan = lambda v: np.nan if v is None else v

        def flat(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            known = ~np.isnan(d)
            return np.where(known, d, 0.0), known

        def rna():
            own = x.own["l_n"][1] & (x.own["l_n"][0] >= run.min_group_n)
            low, target = (np.where(own, np.where(x.own[f"l_{e}"][1], x.own[f"l_{e}"][0], np.nan), nan(c[f"g_{e}"])) for e in "LT")
            ends = np.where(own, x.own["l_L"][1] & x.own["l_T"][1], c["g_L"] is not None and c["g_T"] is not None)
            return flat(_ramp(*x.rna, low, target, ends, role))

        def fixed(values, low, target, role):
            ends = low is not None and target is not None
            return flat(_ramp(*values, np.float64(nan(low)), np.float64(nan(target)), ends, role))

        nothing = lambda: flat(np.full(len(x.at), np.nan))
        out = [x.once(("rna", role, c["g_L"], c["g_T"], run.min_group_n), rna)]
        out.append(x.once(("protein", role), lambda: flat(np.where(x.detected, _ramp(*x.zscore, np.float64(nan(p_low)), np.float64(nan(p_target)), p_low is not None and p_target is not None, role), np.nan))))
        enough = lambda k: c[k] is not None and c[k] >= run.min_calibration_n
        out.append(x.once(("effect", role, c["e_L"], c["e_T"]), lambda: fixed(x.effect, c["e_L"], c["e_T"], role)) if c["broad_fraction"] is None and enough("e_n") else x.once(("none",), nothing))
        copy_role = role if cls == "oncogene" else "exclusion" if role == "inclusion" else "inclusion"
        out.append(x.once(("copies", copy_role, c["c_L"], c["c_T"]), lambda: fixed(x.copy_number, c["c_L"], c["c_T"], copy_role)) if cls != "unknown" and enough("c_n") else x.once(("none",), nothing))
        scores = {cat: (wanted if role == "inclusion" else unwanted) for cat, of, wanted, unwanted in self.rules["events"] if of == cls}
        out.append(x.once(("mutation", role, cls), lambda: flat(np.select([x.category == k for k in scores], list(scores.values()), np.nan) if scores else np.full(len(x.at), np.nan))))
        out.append(x.once(("fusion", role), lambda: flat(np.where(x.fused, np.where(x.present == (role == "inclusion"), 1.0, 0.0), np.nan))))
        weights = [run.weights.get(layer, 0.0) for layer in self.rules["layers"]]
        factor = x.once(("factor",), lambda: self.rules["fusion"] * np.select([x.marks == n for n in self.rules["factors"]], list(self.rules["factors"].values()), 1.0))
        absent = 0.0 if role == "exclusion" else weights[-1]
        weights[-1] = np.where(x.present, factor, np.where(x.fused, absent, weights[-1]))
        return [(d, known, w) for (d, known), w in zip(out, weights)]

    def gene(self, x: Feature, role: str, c: dict, run) -> dict[str, np.ndarray]:
        """The feature score of a scenario and what is counted of it."""
        layers = self.layers(x, role, c, run)
        top = bottom = 0.0
        n = np.zeros(len(x.at), np.int8)
        for d, known, w in layers:
            top, bottom, n = top + w * d, bottom + np.where(known, w, 0.0), n + known
        with np.errstate(all="ignore"):
            d = np.where(bottom > 0, top / bottom, np.nan)
            known = ~np.isnan(d)
            positive = d > 0
            log = np.log(np.where(positive, d, 1.0))
        out = {"known": known, "positive": positive, "zero": d == 0, "log": log, "high": known & (n >= run.high_min_layers), "moderate": known & (n >= run.moderate_min_layers)}
        measured = layers[0][1]
        for name in ("hpa", "geo"):
            value, there = getattr(x, name)
            shared = measured & there
            level = c["g_L"]
            apart = x.once((name, level), lambda: np.zeros(len(x.at), bool) if level is None else ((x.rna[0] >= level) | np.isnan(x.rna[0])) != _above(value, 0.0))  # noqa: B023
            out[name], out[f"{name}_apart"] = shared, shared & apart
        return out

    def combine(self, genes: dict, items: list, parts: list[Feature], constants: dict) -> dict[str, np.ndarray]:
        """The sums of one panel in one scenario, by candidate."""
        n = parts[0].n
        out = {k: np.zeros(n, np.int64) for k in ("n_scored", "n_high", "n_moderate", "_in", "_in_null", "_positive", "hpa", "hpa_apart", "geo", "geo_apart")}
        out |= {"_log": np.zeros(n), "_sum": np.zeros(n), "_at": np.full(n, NEVER)}
        for ordinal, (f, role, weights) in enumerate(items):
            x = parts[f]
            for k in range(len(constants.get(f, ()))):
                g = genes[f, role, k]
                for w in weights or [None]:
                    w = 1.0 if w is None else w
                    for to, name in (("n_scored", "known"), ("n_high", "high"), ("n_moderate", "moderate"), ("_positive", "positive"), ("hpa", "hpa"), ("hpa_apart", "hpa_apart"), ("geo", "geo"), ("geo_apart", "geo_apart")):
                        x.add(out[to], g[name])
                    if role == "inclusion":
                        x.add(out["_in"], np.ones(len(x.at), np.int64))
                        x.add(out["_in_null"], ~g["known"])
                    x.add(out["_log"], w * g["log"])
                    x.add(out["_sum"], np.where(g["known"], w, 0.0))
                    if w > 0:
                        x.add(out["_at"], np.where(g["zero"], ordinal, NEVER), np.minimum)
        return out

    def listed(self, s: dict[str, np.ndarray], run) -> tuple[np.ndarray, np.ndarray]:
        """(which may be displayed, their scores before rounding), as `confidence_tier` and `partition_results` have it."""
        with np.errstate(all="ignore"):
            high, moderate = s["n_high"] / s["n_scored"], s["n_moderate"] / s["n_scored"]
            mean = np.exp(s["_log"] / s["_sum"])
        agreed = (s["hpa"] == 0) | (s["hpa_apart"] == 0)
        sure = ((high >= run.fraction_threshold) & agreed) | (moderate >= run.fraction_threshold)
        return (s["n_scored"] > 0) & (s["abstained"] < run.insufficient_fraction) & sure & (s["_at"] == NEVER) & (s["_positive"] > 0) & (s["_sum"] != 0), mean

    def chunk(self, table: pa.Table, floors: np.ndarray | None, best: int | None) -> Iterator[dict]:
        """The sums of every scenario and panel over whole entities."""
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        lists = {name: Lists(column[name], self.features) for name in ("_cells", "_variants", "_presence", "_own")}
        told = lambda name: pc.not_equal(pc.fill_null(column[name], "not_assayed"), "not_assayed").to_numpy(zero_copy_only=False)
        sequenced, fused = told("mutations_state"), told("fusions_state")
        parts = [Feature(f, lists, sequenced, fused) for f in range(len(self.features))]
        same = same_as_before(column["entity"])
        scopes = []
        for group, _ in self.panels:
            inside = np.arange(len(same)) if group is None else np.flatnonzero(pc.fill_null(pc.equal(column["grp"], group), False).to_numpy(zero_copy_only=False))
            entity = np.cumsum(~same)[inside]
            starts = np.flatnonzero(np.diff(entity, prepend=-1))
            scopes.append((inside, starts, column["entity"].take(pa.array(inside[starts]))))
        asked = sorted({(f, role) for _, items in self.panels for f, role, _ in items})
        for i, run in enumerate(self.scenarios):
            constants = self.constants[i]
            genes = {(f, role, k): self.gene(parts[f], role, c, run) for f, role in asked for k, c in enumerate(constants.get(f, ()))}
            for j, (_, items) in enumerate(self.panels):
                inside, starts, entity = scopes[j]
                if not len(inside) or not any(constants.get(f) for f, _, _ in items):
                    continue
                sums = self.combine(genes, items, parts, constants)
                sums = {k: v[inside] if len(starts) == len(inside) else (np.minimum if k == "_at" else np.add).reduceat(v[inside], starts) for k, v in sums.items()}
                with np.errstate(all="ignore"):
                    sums["abstained"] = np.where(sums["_in"] > 0, sums["_in_null"] / sums["_in"], 1.0)
                if best is not None:
                    shown, mean = self.listed(sums, run)
                    scores = mean[shown]
                    if len(scores) >= best:
                        floors[i, j] = max(floors[i, j], np.partition(scores, len(scores) - best)[len(scores) - best])
                    keep = np.flatnonzero(shown & (mean >= floors[i, j] - SLACK))
                    sums, entity = {k: v[keep] for k, v in sums.items()}, entity.take(pa.array(keep))
                yield {"_scenario": i, "_query": j, "entity": entity, **sums}

    def batch(self, found: list[dict]) -> pa.RecordBatch:
        sizes = [len(x["entity"]) for x in found]
        whole = lambda k: np.concatenate([x[k] for x in found])
        scored, agreement = whole("n_scored"), {k: (whole(k), whole(f"{k}_apart")) for k in ("hpa", "geo")}
        columns = {name: pa.array(np.repeat(np.array([x[name] for x in found], np.int32), sizes)) for name in ("_scenario", "_query")}
        columns["entity"] = pa.concat_arrays([x["entity"] for x in found])
        columns |= {k: pa.array(whole(k)) for k in ("n_scored", "n_high", "n_moderate", "abstained")}
        at = whole("_at")
        columns["_at"] = pa.array(np.minimum(at, NEVER).astype(np.int32), mask=at == NEVER)
        columns["_log"] = pa.array(whole("_log"), mask=whole("_positive") == 0)
        columns["_sum"] = pa.array(whole("_sum"), mask=scored == 0)
        for k, (shared, apart) in agreement.items():
            columns[f"{k}_agreement"] = pa.array(apart == 0, mask=shared == 0)
        return pa.RecordBatch.from_pydict(columns)

    def run(self, best: int | None):
        """The function for `mapInArrow`. An entity's candidates lie together; those of a batch's last entity wait for the next."""

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors = np.full((len(self.scenarios), len(self.panels)), -np.inf)
            held: list[dict] = []
            size = 0
            for table in whole_keys(batches, "entity", CHUNK):
                for found in self.chunk(table, floors, best):
                    if len(found["entity"]):
                        held.append(found)
                        size += len(found["entity"])
                    if size >= OUT_ROWS:
                        yield self.batch(held)
                        held, size = [], 0
            if held:
                yield self.batch(held)

        return over


def same_as_before(keys: pa.Array) -> np.ndarray:
    """Whether a row's key is that of the row before."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[False], codes[1:] == codes[:-1]])


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Tables that end where a key ends: of about `size` rows, or with 0 of a batch each. The rows of a key come one after the other."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        starts = np.flatnonzero(~same_as_before(table.column(key).combine_chunks()))
        done = 0
        while (later := starts[starts >= done + size] if size else starts[-1:]).size and (first := int(later[0])) > done:
            yield table.slice(done, first - done).combine_chunks()
            done = first
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
