"""Names, weights and lookup tables that results depend on."""

# -- Fixed values: input column aliases -------------------------------------
USER_ALIASES = {
    "uid": "user_id",
    "user_name": "username",
    "user_email": "email",
    "dept": "department",
    "emp_status": "employment_status",
    "acct_type": "account_type",
    "mgr_id": "owner_id",
    "source": "source_system",
    "last_auth": "last_login",
    "create_date": "created_at",
    "role_list": "roles",
    "perm_list": "permissions",
    "mfa": "mfa_enabled",
    "sso": "sso_linked",
    "login_count_30": "login_count_30d",
    "login_count_90": "login_count_90d",
    "sys_count": "systems_count",
    "role_changes": "role_changes_90d",
    "privileged": "is_privileged",
    "sensitivity": "resource_sensitivity",
    "off_hours": "off_hours_access_pct",
    "geo_flag": "geo_anomaly",
    "interactive": "interactive_login",
}
# Events keep their own ``off_hours`` flag; the other names are shared.
EVENT_ALIASES = {k: v for k, v in USER_ALIASES.items() if k != "off_hours"}

# -- Fixed values: city to region -------------------------------------------
REGION_BY_LOCATION = {
    "New York, US": "North America",
    "Toronto, CA": "North America",
    "London, UK": "Europe",
    "Paris, FR": "Europe",
    "Berlin, DE": "Europe",
    "Mumbai, IN": "Asia-Pacific",
    "Singapore, SG": "Asia-Pacific",
    "Tokyo, JP": "Asia-Pacific",
    "Sydney, AU": "Asia-Pacific",
    "Sao Paulo, BR": "South America",
}

# -- Fixed values: seniority keywords, in tie order -------------------------
SENIORITY = [
    ("cto", -25),
    ("ciso", -25),
    ("cfo", -20),
    ("ceo", -25),
    ("vp", -15),
    ("svp", -15),
    ("evp", -15),
    ("director", -15),
    ("chief", -20),
]

SENSITIVITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# -- Fixed values: rule id, default severity, score weight, in output order --
RULES = [
    ("STALE_PRIVILEGED", "HIGH", 50),
    ("ORPHANED_ACCOUNT", "CRITICAL", 25),
    ("OVER_PRIVILEGED", "HIGH", 25),
    ("SHADOW_ADMIN", "CRITICAL", 55),
    ("PRIVILEGE_CREEP", "MEDIUM", 35),
    ("SERVICE_ACCT_ABUSE", "CRITICAL", 45),
    ("CREDENTIAL_SPRAWL", "MEDIUM", 25),
    ("IMPOSSIBLE_TRAVEL", "CRITICAL", 55),
    ("CROSS_SYSTEM_TRAVEL", "CRITICAL", 0),
    ("EXCESSIVE_ACCESS", "HIGH", 25),
    ("LATERAL_MOVEMENT_SPIKE", "CRITICAL", 0),
    ("BULK_DOWNLOAD", "CRITICAL", 45),
    ("SOD_VIOLATION", "CRITICAL", 55),
]
RULE_IDS = [r[0] for r in RULES]
RULE_WEIGHTS = {r[0]: r[2] for r in RULES}

# -- Fixed values: segregation-of-duty pairs --------------------------------
SOD_CONFLICTS = [
    (1, "SOD-001", "finance_approver", "payment_executor",
     "User can both approve and execute payments. Fraud risk.", "CRITICAL", "SOX Section 302"),
    (2, "SOD-002", "admin", "auditor",
     "User can administer systems and erase audit trails.", "CRITICAL", "NIST AC-5"),
    (3, "SOD-003", "developer", "deployer",
     "Developer can deploy their own code to production.", "HIGH", "NIST CM-5"),
    (4, "SOD-004", "security_admin", "auditor",
     "User can set security policy and review their own audit logs.", "CRITICAL", "SOX Section 404"),
    (5, "SOD-005", "admin", "security_admin",
     "User can provision accounts and set their own permissions.", "HIGH", "NIST AC-2"),
]

# -- Fixed values: attack techniques and the rules that point to them -------
TECHNIQUES = [
    ("T1078", "Valid Accounts", "Defense Evasion"),
    ("T1136", "Create Account", "Persistence"),
    ("T1098", "Account Manipulation", "Persistence"),
    ("T1134", "Access Token Manipulation", "Privilege Escalation"),
    ("T1098.001", "Additional Cloud Credentials", "Persistence"),
    ("T1078.003", "Local Accounts", "Defense Evasion"),
    ("T1078.004", "Cloud Accounts", "Defense Evasion"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1021", "Remote Services", "Lateral Movement"),
    ("T1048", "Exfiltration Over Alt Channel", "Exfiltration"),
]
TECHNIQUE_URL_ROOT = "https://attack.mitre.org/techniques/"
RULE_TECHNIQUE = {
    "STALE_PRIVILEGED": "T1078",
    "ORPHANED_ACCOUNT": "T1136",
    "OVER_PRIVILEGED": "T1098",
    "SHADOW_ADMIN": "T1134",
    "PRIVILEGE_CREEP": "T1098.001",
    "SERVICE_ACCT_ABUSE": "T1078.003",
    "CREDENTIAL_SPRAWL": "T1078.004",
    "IMPOSSIBLE_TRAVEL": "T1078",
    "EXCESSIVE_ACCESS": "T1021",
    "LATERAL_MOVEMENT_SPIKE": "T1021",
    "BULK_DOWNLOAD": "T1048",
    "SOD_VIOLATION": "T1134",
}

# -- Fixed values: remediation ----------------------------------------------
RULE_ACTION = {
    "STALE_PRIVILEGED": "DISABLE_ACCOUNT",
    "ORPHANED_ACCOUNT": "DISABLE_ACCOUNT",
    "OVER_PRIVILEGED": "RESTRICT_SCOPE",
    "SHADOW_ADMIN": "REVOKE_ROLE",
    "PRIVILEGE_CREEP": "REVOKE_ROLE",
    "SERVICE_ACCT_ABUSE": "BLOCK_INTERACTIVE_LOGIN",
    "CREDENTIAL_SPRAWL": "LINK_SSO",
    "IMPOSSIBLE_TRAVEL": "ROTATE_CREDENTIALS",
    "EXCESSIVE_ACCESS": "SCOPE_TO_RESOURCES",
    "BULK_DOWNLOAD": "DISABLE_ACCOUNT",
    "SOD_VIOLATION": "REVOKE_ROLE",
}
ACTION_SLA_HOURS = {
    "DISABLE_ACCOUNT": 4,
    "REVOKE_ROLE": 8,
    "ROTATE_CREDENTIALS": 4,
    "RESTRICT_SCOPE": 16,
    "FLAG_HR_REVIEW": 48,
    "ENABLE_MFA": 24,
    "LINK_SSO": 72,
    "VERIFY_WITH_MANAGER": 24,
    "BLOCK_INTERACTIVE_LOGIN": 8,
    "SCOPE_TO_RESOURCES": 24,
}
ACTIONS_NEEDING_APPROVAL = ["DISABLE_ACCOUNT", "REVOKE_ROLE"]
SEVERITY_REDUCTION = {"CRITICAL": 30, "HIGH": 20, "MEDIUM": 10, "LOW": 5}
DISABLE_COMMANDS = {
    "AD": "Disable-ADAccount -Identity {username}",
    "AzureAD": "az ad user update --id {email} --account-enabled false",
    "AWS_IAM": "aws iam delete-login-profile --user-name {username}",
    "GCP": "gcloud iam service-accounts disable {email}",
    "Okta": "okta users deactivate --login {email}",
}
DISABLE_COMMAND_OTHER = "Disable account {username} on {source_system}"
ACTION_COMMANDS = {
    "REVOKE_ROLE": "Remove role assignments for {username} on {source_system}",
    "ROTATE_CREDENTIALS":
        "Force password reset: Set-ADUser -Identity {username} -ChangePasswordAtLogon $true",
    "RESTRICT_SCOPE": "Limit {username} to job-specific resources on {source_system}",
    "ENABLE_MFA": "Enforce MFA enrollment for {username} on {source_system}",
    "LINK_SSO": "Link {username} to SSO provider on {source_system}",
    "BLOCK_INTERACTIVE_LOGIN":
        "Block interactive login for service account {username} on {source_system}",
    "VERIFY_WITH_MANAGER": "Notify manager for {username} on {source_system} to verify access",
    "FLAG_HR_REVIEW": "Flag {username} for HR access review on {source_system}",
    "SCOPE_TO_RESOURCES": "Scope {username} to job-specific resources on {source_system}",
}

# -- Fixed values: compliance gaps ------------------------------------------
COMPLIANCE_GAPS = [
    ("STALE_PRIVILEGED", "NIST SP 800-53", "AC-2", "Account Management",
     "Inactive privileged account not disabled within review cycle.",
     "Disable or suspend account. Document exception if active."),
    ("ORPHANED_ACCOUNT", "NIST SP 800-53", "AC-2(3)", "Disable Inactive Accounts",
     "Account has no owner and cannot be reviewed or recertified.",
     "Assign owner or disable immediately."),
    ("OVER_PRIVILEGED", "GDPR", "Article 32", "Security of Processing",
     "User has access to sensitive data beyond role requirements.",
     "Apply least-privilege: revoke unused permissions."),
    ("SOD_VIOLATION", "SOX", "Section 302", "Corporate Responsibility",
     "Role combination creates financial control bypass risk.",
     "Separate conflicting roles. Require dual approval."),
    ("SHADOW_ADMIN", "NIST SP 800-53", "AC-6", "Least Privilege",
     "Admin permissions granted outside formal role assignment.",
     "Remove direct permission grant. Use role-based assignment."),
]

# -- Fixed values: feature vector order -------------------------------------
FEATURE_NAMES = [
    "days_since_login",
    "permission_utilization",
    "role_count",
    "system_count",
    "role_change_velocity",
    "is_privileged_flag",
    "has_owner_flag",
    "hr_mismatch_flag",
    "off_hours_access_pct",
    "geo_anomaly_flag",
    "sso_linked_flag",
    "mfa_enabled_flag",
    "sensitivity_score",
    "behavior_zscore",
    "account_age_days",
    "event_anomaly_rate",
    "failed_attempt_rate",
    "unique_resources_30d",
    "bulk_download_flag",
    "impossible_travel_flag",
    "after_hours_event_pct",
    "peer_deviation_score",
    "avg_time_between_events_h",
]

# -- Fixed values: event vocabularies ---------------------------------------
EXPORT_ACTIONS = ["download", "export_data", "export"]
AFTER_HOURS_CLASSES = ["unusual_hours", "night", "weekend"]
TRUE_WORDS = ["true", "1", "yes", "t", "y"]
EVENT_TRUE_WORDS = ["true", "1", "yes"]
LABEL_TRUE_WORDS = ["true", "1", "yes", "t"]
PRIVILEGED_POLICY_WORDS = ["admin", "poweruser", "fullaccess", "administrator"]
ABSENT_DATE_WORDS = ["n/a", "not_supported", "no_information", ""]
