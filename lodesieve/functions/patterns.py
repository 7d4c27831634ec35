"""What the scan looks for: one row per pattern, in the order in which findings are reported."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

# Patterns, labels, word lists and severities are part of the results' definition.

LABEL = r'"?\s*[:=]\s*"?'
PLACEHOLDER = r"(?is)^(?:.{0,3}|\*+|\[?(?:redacted|masked|hidden|null|undefined|none|todo|fixme|example|sample)\]?|x{3,})$"
SENTINEL = r"(?i)^(?:\*+|\[?(?:redacted|masked|hidden|null|undefined|none)\]?)$"
FILE_PATH = r"^\.{0,2}/[^,;'\"]+"
OWNED_LABEL = r"(?i)(?:jwt|bearer|access[_-]?token|refresh[_-]?token|public[_-]?token|api[_-]?token|client[_-]?secret|client[_-]?id|cardholder|expiry|password|passwd|pwd|csrf|xsrf|session|sid)"
CURRENCY = r"(?i)(?:AED|USD|EUR|GBP|SAR|JPY|INR|CNY)$"
CLIENT_IP = r"\b(?:client_ip|source_ip|src_ip|remote_addr|customer_ip|user_ip|x_forwarded_for|real_ip|origin_ip)" + LABEL
#: Octets over 255, and addresses that aren't public.
NOT_PUBLIC = (
    r"(?:^|\.)(?:2[6-9]\d|25[6-9]|[3-9]\d\d)(?:\.|$)"
    r"|^(?:0?10|127|0{1,3}|22[4-9]|2[3-9]\d)\.|^169\.254\.|^192\.168\."
    r"|^172\.0?(?:1[6-9]|2\d|3[01])\.|^100\.(?:0?(?:6[4-9]|[7-9]\d)|1[01]\d|12[0-7])\."
)
#: Card brands by length and leading digits, first match wins.
BRANDS = [
    ("AMEX", r"^3[47]\d{13}$"),
    ("VISA", r"^4(?:\d{12}|\d{15}|\d{18})$"),
    ("MASTERCARD", r"^(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)\d{12}$"),
    ("DISCOVER", r"^(?:6011\d{2}|65\d{4}|64[4-9]\d{3}|62212[6-9]|6221[3-9]\d|622[2-8]\d{2}|6229[01]\d|62292[0-5])(?:\d{10}|\d{13})$"),
    ("JCB", r"^(?:352[89]|35[3-8]\d)(?:\d{12}|\d{15})$"),
    ("DINERS", r"^(?:30[0-5]\d{11}|3[68]\d{12})$"),
    ("UNIONPAY", r"^62(?:\d{14}|\d{17})$"),
]


@dataclass(frozen=True)
class Pattern:
    name: str  #: of the operator; several patterns may share it
    rule: str
    severity: str
    category: str
    regex: str  #: \b and \d mean ASCII, \s means Unicode's white space, case is ignored in ASCII only
    group: int = 0  #: what is reported; the span is always the whole match
    check: str = ""  #: a key of lodesieve.functions.checks.CHECKS
    fold: bool = False  #: ignore case


PCI, PII, SEC, OPS = "LOG_PCI", "LOG_PII", "LOG_SECRET", "LOG_OPS"

PATTERNS = [
    Pattern("pan", "LOG-PCI-001", "CRITICAL", PCI, r"(?:\d[ -]?){13,19}", 0, "pan"),
    Pattern("url_encoded_pan", "LOG-PCI-001", "CRITICAL", PCI, r"(?:%3[0-9]){13,19}", 0, "encoded_pan"),
    Pattern("cvv", "LOG-PCI-002", "CRITICAL", PCI, r"\b(?:cvv|cvc|csc|card[_-]?verification)" + LABEL + r"(\d{3,4})\b", 1, "", True),
    Pattern("track_data", "LOG-PCI-003", "CRITICAL", PCI, r"%B\d{12,19}\^[^^]{2,26}\^\d{4,}\?"),
    Pattern("track_data", "LOG-PCI-003", "CRITICAL", PCI, r";\d{12,19}=\d{4,}\?"),
    Pattern("emirates_id", "LOG-PII-001", "HIGH", PII, r"\b784[- ]?\d{4}[- ]?\d{7}[- ]?\d\b", 0, "emirates"),
    Pattern("iban", "LOG-PII-002", "HIGH", PII, r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0, "iban"),
    Pattern("email", "LOG-PII-003", "MEDIUM", PII, r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b"),
    Pattern("uae_phone", "LOG-PII-004", "MEDIUM", PII, r"(?:\+971[- ]?|00971[- ]?|0)(?:50|52|54|55|56|58)[- ]?\d{7}\b"),
    Pattern("passport", "LOG-PII-005", "HIGH", PII, r"""\b(?:passport(?:[_-]?(?:no|number|id))?)\s*[:=]\s*"?([A-Z][0-9A-Z]{6,9})\b""", 1, "", True),
    Pattern("plaintext_password", "LOG-SEC-001", "CRITICAL", SEC, r"""\b(?:password|passwd|pwd|userPassword)\s*[:=]\s*("[^"\\]{6,}"|'[^'\\]{6,}'|[^\s,;)]+)""", 1, "password", True),
    Pattern("env_var_password", "LOG-SEC-001", "CRITICAL", SEC, r"""\b[A-Z][A-Z0-9_]{1,40}(?:PASSWORD|PASSWD|PWD|SECRET|KEY|TOKEN)=([^\s,;'"]+)""", 1, "env_value"),
    Pattern("bearer_or_jwt", "LOG-SEC-002", "CRITICAL", SEC, r"\bBearer\s+([A-Za-z0-9._\-/+=]{20,})", 1),
    Pattern("bearer_or_jwt", "LOG-SEC-002", "CRITICAL", SEC, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{6,}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bAKIA[0-9A-Z]{16}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bsk_live_[0-9a-zA-Z]{24,}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bsk_test_[0-9a-zA-Z]{24,}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bgh[psou]_[A-Za-z0-9]{36,}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bAIza[0-9A-Za-z_-]{35}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bSG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b"),
    Pattern("service_api_key", "LOG-SEC-003", "CRITICAL", SEC, r"\bAC[a-f0-9]{32}\b"),
    Pattern("aws_session_token", "LOG-SEC-003", "CRITICAL", SEC, r"\b(?:FwoGZXIvYXdz|IQoJb3JpZ2luX2VjE)[A-Za-z0-9+/=]{40,}\b"),
    Pattern("private_key", "LOG-SEC-004", "CRITICAL", SEC, r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"),
    Pattern("db_connection", "LOG-OPS-001", "HIGH", OPS, r"\b(?:mongodb|postgres(?:ql)?|mysql|mariadb|amqp|redis|rediss?|kafka)://[^:/\s]+:[^@/\s]+@[^\s,)]+"),
    Pattern("sensitive_path", "LOG-OPS-002", "LOW", OPS, r"/[^\s:]*/(?:secrets|keys|vault|credentials|private)/[^\s:]+", 0, "", True),
    Pattern("customer_name", "LOG-PII-006", "MEDIUM", PII, r"\b(?:firstName|lastName|fullName|customerName|first_name|last_name|full_name|customer_name)" + LABEL + r"""([^,;'"\s]{2,}(?:[ \-][A-Z][A-Za-z]+){1,5})""", 1, "real", True),
    Pattern("date_of_birth", "LOG-PII-007", "HIGH", PII, r"\b(?:dob|dateOfBirth|date_of_birth|birthDate|birth_date)" + LABEL + r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", 1, "", True),
    Pattern("address", "LOG-PII-008", "MEDIUM", PII, r"""\b(?:address|streetAddress|street_address|homeAddress|home_address|customer_address)"?\s*[:=]\s*"([A-Za-z0-9][A-Za-z0-9 ,.#\-/']{12,200})\"""", 1, "with_digit", True),
    Pattern("bank_account", "LOG-ACCT-001", "HIGH", PII, r"\b(?:account_?number|acc_?no|accountId)" + LABEL + r"(\d{8,18})", 1, "", True),
    Pattern("sort_code", "LOG-ACCT-002", "MEDIUM", PII, r"\b(?:sort_?code|routing_?number|aba)" + LABEL + r"(\d{2,3}[- ]?\d{2,3}[- ]?\d{2,4}|\d{6,9})", 1, "", True),
    Pattern("swift_bic", "LOG-ACCT-003", "MEDIUM", PII, r"\b(?:swift|bic|swiftCode|bicCode)" + LABEL + r"([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1),
    Pattern("driving_license", "LOG-DOC-001", "HIGH", PII, r"\b(?:driving_?license|driver_?license|dl_?no|dl_?number|drivingLicense)" + LABEL + r"([A-Z]{0,3}[ -]?\d{7,9})\b", 1, "", True),
    Pattern("visa_permit", "LOG-DOC-002", "HIGH", PII, r"\b(?:visa|visa_?no|residence_?permit|residency_?permit|residence_?id)" + LABEL + r"(\d{1,3}/\d{1,4}/\d{4,12}|[A-Z]{1,3}[-]?\d{4,12})", 1, "", True),
    Pattern("tax_number", "LOG-DOC-003", "MEDIUM", PII, r"\b(?:trn|tax_?reg(?:istration)?_?(?:number|no))" + LABEL + r"(\d{15})\b", 1, "", True),
    Pattern("national_id", "LOG-DOC-004", "MEDIUM", PII, r"\b(?:national_?id|nationalId|id_?number|government_?id)" + LABEL + r"([A-Z0-9][A-Z0-9-]{6,20})\b", 1, "not_784", True),
    Pattern("card_expiry", "LOG-PCI-005", "MEDIUM", PCI, r"\b(?:exp|expiry|expiration|cardExpiry|card_expiry|exp_?date)" + LABEL + r"((?:0[1-9]|1[0-2])[/\-](?:\d{2}|\d{4}))\b", 1, "expiry", True),
    Pattern("cardholder", "LOG-PCI-006", "MEDIUM", PCI, r'\b(?:cardholder|cardholderName|card_holder|holder_name)"?\s*[:=]\s*"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4})"', 1, "real"),
    Pattern("balance", "LOG-FIN-001", "MEDIUM", PII, r"\b(?:balance|availableBalance|available_balance|current_balance|ledger_balance)" + LABEL + r'(\d[\d,]*(?:\.\d{1,4})?)\s*"?\s*(?:AED|USD|EUR|GBP|SAR|JPY|INR|CNY)?', 1, "balance", True),
    Pattern("customer_ipv4", "LOG-NET-001", "MEDIUM", PII, CLIENT_IP + r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", 1, "public_ip", True),
    Pattern("customer_ipv6", "LOG-NET-002", "MEDIUM", PII, CLIENT_IP + r"((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})", 1, "ipv6"),
    Pattern("internal_ip", "LOG-NET-003", "LOW", OPS, r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|100\.(?:6[4-9]|[7-9]\d|1[0-1]\d|12[0-7])\.\d{1,3}\.\d{1,3})\b"),
    Pattern("oauth_credentials", "LOG-SEC-005", "CRITICAL", SEC, r"\bclient[_-]?secret" + LABEL + r"""([^\s,;'"]{8,})""", 1, "real", True),
    Pattern("oauth_credentials", "LOG-SEC-006", "MEDIUM", SEC, r"\bclient[_-]?id" + LABEL + r"([A-Za-z0-9._\-]{8,})", 1, "real", True),
    Pattern("oauth_credentials", "LOG-SEC-007", "CRITICAL", SEC, r"\brefresh[_-]?token" + LABEL + r"([A-Za-z0-9._\-/+=]{16,})", 1, "real", True),
    Pattern("session_token", "LOG-SEC-008", "CRITICAL", SEC, r"\b(?:session[_-]?token|sessionId|session_id|sid|jsessionid|phpsessid)" + LABEL + r"([A-Za-z0-9._\-/+=]{12,})", 1, "real", True),
    Pattern("csrf_token", "LOG-SEC-009", "HIGH", SEC, r"\b(?:csrf[_-]?token|xsrf[_-]?token|_csrf|anti[_-]?forgery)" + LABEL + r"([A-Za-z0-9._\-/+=]{16,})", 1, "real", True),
    Pattern("ssh_key", "LOG-SEC-010", "CRITICAL", SEC, r"\bssh-(?:rsa|dss|ed25519|ecdsa-sha2-nistp(?:256|384|521))\s+[A-Za-z0-9+/]{40,}={0,2}"),
    Pattern("azure_sas", "LOG-SEC-011", "CRITICAL", SEC, r"""\?sv=\d{4}-\d{2}-\d{2}[^\s"']*?&sig=[A-Za-z0-9%+/=_-]{10,}"""),
    Pattern("gcp_service_account", "LOG-SEC-012", "CRITICAL", SEC, r'"type"\s*:\s*"service_account"(?s:.){1,400}?"private_key"\s*:\s*"-----BEGIN'),
    Pattern("api_token", "LOG-SEC-013", "HIGH", SEC, r"\b(?:public[_-]?token|api[_-]?token|access[_-]?token|app[_-]?token|integration[_-]?token)" + LABEL + r"([A-Za-z0-9._\-/+=]{16,})", 1, "real", True),
    Pattern("high_entropy_secret", "LOG-SEC-014", "HIGH", SEC, r"\b[A-Za-z][A-Za-z0-9_-]{1,40}(?:secret|key|token|password|credential)" + LABEL + r"([A-Za-z0-9._\-/+=]{24,})", 1, "entropy", True),
    Pattern("basic_auth", "LOG-SEC-002", "CRITICAL", SEC, r'\bAuthorization\s*[:=]\s*"?Basic\s+([A-Za-z0-9+/=]{16,})', 1),
    Pattern("webhook_url", "LOG-SEC-003", "CRITICAL", SEC, r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}"),
    Pattern("webhook_url", "LOG-SEC-003", "CRITICAL", SEC, r"https://(?:ptb\.|canary\.)?discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_\-]{24,}"),
    Pattern("webhook_url", "LOG-SEC-003", "CRITICAL", SEC, r"""https://[^\s"']+\.webhook\.office\.com/webhookb2/[a-f0-9-]+@[a-f0-9-]+/IncomingWebhook/[A-Za-z0-9]+"""),
    Pattern("service_keys_extra", "LOG-SEC-003", "CRITICAL", SEC, r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    Pattern("service_keys_extra", "LOG-SEC-003", "CRITICAL", SEC, r"\bnpm_[A-Za-z0-9]{36}\b"),
    Pattern("service_keys_extra", "LOG-SEC-003", "CRITICAL", SEC, r"\bsk-[A-Za-z0-9]{20,}T3BlbkFJ[A-Za-z0-9]{20,}\b"),
    Pattern("service_keys_extra", "LOG-SEC-003", "CRITICAL", SEC, r"\bhe[ks]u_[A-Za-z0-9_-]{36,}\b"),
    Pattern("presigned_url", "LOG-SEC-003", "CRITICAL", SEC, r"X-Amz-Signature=[A-Fa-f0-9]{32,}"),
    Pattern("presigned_url", "LOG-SEC-003", "CRITICAL", SEC, r"X-Goog-Signature=[A-Fa-f0-9]{32,}"),
    Pattern("presigned_url", "LOG-SEC-003", "CRITICAL", SEC, r"\bsig=[A-Za-z0-9%+/=_-]{20,}&se=\d"),
    Pattern("us_ssn", "LOG-PII-009", "CRITICAL", PII, r"\b\d{3}-\d{2}-\d{4}\b", 0, "ssn"),
    Pattern("pem_key_body", "LOG-SEC-004", "CRITICAL", SEC, r"\b(?:private[_-]?key|pkcs8|rsa[_-]?key|signing[_-]?key)" + LABEL + r"(MII[A-Za-z0-9+/=]{600,})", 1, "pem_entropy"),
    Pattern("uk_ni", "LOG-PII-009", "HIGH", PII, r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b"),
    Pattern("pakistani_cnic", "LOG-PII-009", "HIGH", PII, r"\b\d{5}-\d{7}-\d\b"),
    Pattern("indian_aadhaar", "LOG-PII-009", "HIGH", PII, r"\b(?:aadhaar|aadhar|uidai)" + LABEL + r"(\d{4}[ -]?\d{4}[ -]?\d{4})\b", 1, "", True),
]

#: Rules that are left out unless asked for.
HEURISTIC = ["LOG-PII-003", "LOG-PII-005", "LOG-PII-008", "LOG-ACCT-003", "LOG-DOC-003", "LOG-DOC-004", "LOG-FIN-001", "LOG-NET-002", "LOG-NET-003", "LOG-SEC-006", "LOG-SEC-009", "LOG-SEC-014", "LOG-OPS-002"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]

# End of fixed values.

#: The white space that \s stands for in these patterns.
SPACES = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def portable(regex: str, spaces: str = SPACES) -> str:
    """\\s spelled out, inside and outside brackets."""
    return re.sub(r"(\\.)|(\[\^?)|(\])", _spelled(spaces), regex)


def _spelled(spaces: str):
    inside = False

    def one(m: re.Match) -> str:
        nonlocal inside
        if m[1] == r"\s":
            return spaces if inside else f"[{spaces}]"
        inside = inside if m[1] else m[2] is not None
        return m[0]

    return one


@cache
def re2(p: Pattern) -> str:
    """For engines of the RE2 kind: Arrow's, by which texts are told apart that may have a match, and DuckDB's."""
    return ("(?i)" if p.fold else "") + portable(p.regex)


@cache
def compiled(p: Pattern) -> re.Pattern:
    """For finding the matches of a text."""
    spaces = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACES)
    return re.compile(portable(p.regex, spaces), re.ASCII | (re.IGNORECASE if p.fold else 0))
