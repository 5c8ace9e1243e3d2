"""Exported identity-provider dumps: normalisation, matching, credential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions.parsing import parse_timestamp

AWS_MAIL_DOMAIN = "company.com"
PRIORITY = {"okta": 1, "azuread": 2, "aws_iam": 3}


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _local_part(address: Column) -> Column:
    return F.split(address, "@")[0]


def _identity(provider: str, external_id, username, email, display_name, status, last_login, raw: dict) -> list[Column]:
    entries = [x for k, v in raw.items() for x in (F.lit(k), _text(v))]
    none = F.array().cast("array<string>")
    return [
        F.lit(provider).alias("provider"), _text(external_id).alias("external_id"), _text(username).alias("username"),
        _text(email).alias("email"), _text(display_name).alias("display_name"), status.alias("status"),
        last_login.alias("last_login"), none.alias("groups"), none.alias("roles"),
        F.create_map(*entries).alias("raw_attributes"),
    ]


def normalise_okta(export: DataFrame) -> DataFrame:
    login = _text(F.col("profile.login"))
    status = F.lower(_text(F.col("status")))
    return export.select(*_identity(
        "okta", F.col("id"), _local_part(login), F.coalesce(F.col("profile.email"), login),
        F.trim(F.concat_ws(" ", F.col("profile.firstName"), F.col("profile.lastName"))),
        F.when(status == "active", "active").when(status.isin("inactive", "deprovisioned"), "inactive")
        .otherwise("suspended"),
        _optional(export, "lastLogin"),
        {"status": F.col("status"), "created": _optional(export, "created")},
    ))


def normalise_azure(export: DataFrame) -> DataFrame:
    upn = _text(F.col("userPrincipalName"))
    return export.select(*_identity(
        "azuread", F.col("id"), _local_part(upn), F.coalesce(F.col("mail"), upn), F.col("displayName"),
        F.when(F.coalesce(F.col("accountEnabled"), F.lit(True)), "active").otherwise("inactive"),
        F.lit(None).cast("string"),
        {"jobTitle": _optional(export, "jobTitle"), "department": _optional(export, "department")},
    ))


def normalise_aws(export: DataFrame, domain: str = AWS_MAIL_DOMAIN) -> DataFrame:
    name, used = _text(F.col("UserName")), _text(_optional(export, "PasswordLastUsed"))
    return export.select(*_identity(
        "aws_iam", F.coalesce(F.col("UserId"), _optional(export, "Arn")), name,
        F.when(name != "", F.concat(name, F.lit("@" + domain))).otherwise(""), name,
        F.when(used != "", "active").otherwise("inactive"), F.when(used != "", used),
        {"CreateDate": _optional(export, "CreateDate")},
    ))


def all_providers(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


# -- matching -------------------------------------------------------------------

def _mail_key(row_id: str) -> Column:
    """Lower-cased address; rows without one get a key of their own, so blanks never pile up on one task."""
    mail = F.lower(F.trim(_text(F.col("email"))))
    return F.when(mail != "", mail).otherwise(F.concat(F.lit("no address: "), F.col(row_id)))


def match_identities(users: DataFrame, provider_users: DataFrame) -> DataFrame:
    """Every internal user with the best provider record of the same address, or none."""
    priority = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("provider")), F.lit(9)
    )
    best = provider_users.where("email <> ''").groupBy(_mail_key("external_id").alias("__mail")).agg(
        F.min_by(F.struct("provider", "external_id", "status"), F.struct(priority, "external_id")).alias("idp")
    )
    joined = users.withColumn("__mail", _mail_key("user_id")).join(best, "__mail", "left")
    return joined.select("user_id", "email", F.col("idp.provider").alias("provider"),
                         F.col("idp.external_id").alias("external_id"), F.col("idp.status").alias("provider_status"),
                         F.col("idp").isNotNull().alias("matched"))


def internal_only(users: DataFrame, provider_users: DataFrame) -> DataFrame:
    """Internal users no provider knows."""
    known = provider_users.where("email <> ''").select(_mail_key("external_id").alias("__mail"))
    return users.withColumn("__mail", _mail_key("user_id")).join(known, "__mail", "left_anti").drop("__mail")


def provider_only(users: DataFrame, provider_users: DataFrame) -> DataFrame:
    """Provider accounts without an internal user."""
    known = users.where("email <> ''").select(_mail_key("user_id").alias("__mail"))
    return provider_users.withColumn("__mail", _mail_key("external_id")).join(known, "__mail", "left_anti").drop("__mail")


def matched_count(users: DataFrame, provider_users: DataFrame) -> DataFrame:
    """Distinct internal addresses that some provider knows."""
    mails = users.where("email <> ''").select(_mail_key("user_id").alias("m")).distinct()
    known = provider_users.where("email <> ''").select(_mail_key("external_id").alias("m"))
    return mails.join(known, "m", "left_semi").agg(F.count(F.lit(1)).alias("matched_emails"))


def provider_summary(provider_users: DataFrame) -> DataFrame:
    active = F.count_if(F.col("status") == "active")
    return provider_users.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), active.alias("active"), (F.count(F.lit(1)) - active).alias("inactive")
    )


def access_key_summary(keys: DataFrame) -> DataFrame:
    """Totals over all keys; sprawl as in the whole account (two or more active keys)."""
    active = F.count_if(F.col("Status") == "Active")
    return keys.agg(
        F.count(F.lit(1)).alias("total_keys"), active.alias("active_keys"),
        (F.count(F.lit(1)) - active).alias("inactive_keys"), (active >= 2).alias("key_sprawl_detected"),
    )


def access_keys_by_user(keys: DataFrame) -> DataFrame:
    active = F.count_if(F.col("Status") == "Active")
    return keys.groupBy("UserName").agg(active.alias("active_keys"), (active >= 2).alias("key_sprawl"))


# -- credential report ----------------------------------------------------------

def _unused(c: str, cutoff: Column) -> Column:
    absent = F.lower(F.trim(F.col(c))).isin(fv.ABSENT_DATE_WORDS)
    iso = F.col(c).rlike(r"^\s*\d{4}-")
    return F.when(~absent & iso, parse_timestamp(F.col(c)) < cutoff)


def credential_metrics(report: DataFrame, as_of: Column) -> DataFrame:
    """One row of counters; a user with two active keys adds two to the key total."""
    cutoff = F.date_trunc("day", as_of) - F.make_dt_interval(F.lit(90))
    is_true = lambda c: F.lower(F.col(c)) == "true"
    key_1, key_2 = F.count_if(is_true("access_key_1_active")), F.count_if(is_true("access_key_2_active"))
    return report.agg(
        F.count(F.lit(1)).alias("total_report_users"),
        F.count_if(F.lower("mfa_active") == "false").alias("users_with_mfa_disabled"),
        F.count_if(is_true("password_enabled")).alias("users_with_password_enabled"),
        (key_1 + key_2).alias("users_with_active_access_keys"),
        key_1.alias("users_with_access_key_1_active"),
        key_2.alias("users_with_access_key_2_active"),
        F.count_if(_unused("password_last_used", cutoff)).alias("users_with_password_unused_90d"),
        F.count_if(_unused("access_key_1_last_used_date", cutoff)).alias("users_with_access_key_1_unused_90d"),
        F.count_if(_unused("access_key_2_last_used_date", cutoff)).alias("users_with_access_key_2_unused_90d"),
    )


def credential_flags(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        (F.col("users_with_mfa_disabled") > 0).alias("mfa_gap"),
        (F.col("users_with_active_access_keys") >= 2).alias("credential_sprawl"),
    )


def privileged_by_policy(users: DataFrame) -> DataFrame:
    """Users with a policy name that points to administrative rights."""
    names = F.lower(F.concat_ws(" ", "attached_policy_names", "inline_policy_names"))
    return users.where(names.rlike("|".join(fv.PRIVILEGED_POLICY_WORDS)))
