"""Output schemas of the modelling steps."""

from __future__ import annotations

from quernix.functions.compile import Field
from quernix.plans import steps as S

SUMMARY = {"n": "int", "df": "int", "sigma": "float", "r2": "float", "rank": "int", "deviance": "float", "null_deviance": "float", "dispersion": "float", "iterations": "int", "converged": "bool"}
THETA = {"theta": "float", "theta_std_error": "float", "alternations": "int"}


def fit_schema(s: S.Fit, schema: dict[str, Field]) -> dict[str, Field]:
    keys = {k: schema[k] for k in s.group_by}
    if s.output == "coefficients":
        return keys | {"term": Field("string"), "estimate": Field("float"), "std_error": Field("float"), "t": Field("float"), "unit": Field("string")}
    if s.output == "summary":
        return keys | {k: Field(t) for k, t in (SUMMARY | (THETA if s.family == "negativeBinomial" else {})).items()}
    return schema | {("fitted" if s.output == "fitted" else "residual"): Field("float", schema[s.response].unit)}


def predict_schema(s: S.Predict, schema: dict[str, Field]) -> dict[str, Field]:
    out = schema | {"predicted": Field("float")}
    if s.model_from == "training":
        out |= {"se_fit": Field("float"), "se_pred": Field("float")}
        if s.interval:
            out |= {"lower": Field("float"), "upper": Field("float")}
    return out


def kmeans_schema(s: S.KMeans, schema: dict[str, Field]) -> dict[str, Field]:
    keys = {k: schema[k] for k in s.group_by}
    if s.output == "assignments":
        return schema | {"cluster": Field("int")}
    if s.output == "centres":
        return keys | {"cluster": Field("int")} | {n: Field("float") for n, _ in s.features} | {"size": Field("int"), "withinSS": Field("float")}
    out = keys | {"k": Field("int"), "restarts": Field("int"), "iterations": Field("int"), "withinSS": Field("float"), "converged": Field("bool"), "seed": Field("decimal(20,0)")}
    return out | ({"silhouette": Field("float")} if s.silhouette else {})


def bootstrap_schema(s: S.Bootstrap, schema: dict[str, Field]) -> dict[str, Field]:
    keys = {k: schema[k] for k in s.group_by}
    if s.output == "summary":
        return keys | {"aggregate": Field("string"), "estimate": Field("float"), "std_error": Field("float"), "lower": Field("float"), "upper": Field("float")}
    from quernix.plans.engine import aggregate

    return keys | {"replicate": Field("int")} | {a.name: aggregate(a, schema, True)[1] for a in s.aggregates}


def schema_after(s, schema: dict[str, Field]) -> dict[str, Field]:
    return {S.Fit: fit_schema, S.Predict: predict_schema, S.KMeans: kmeans_schema, S.Bootstrap: bootstrap_schema}[type(s)](s, schema)
