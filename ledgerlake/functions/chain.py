"""Column expressions of the decode and report jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.fixed import APPROVAL, BOTS, FLOW_PREFIXES, FLOW_TOKENS, MINT, SWAP, TRANSFER, ZERO_ADDRESS
from ledgerlake.functions.u256 import hex_to_text, let, limbs_from_hex

UNKNOWN_SENDER = "0xunknown"
CREATION = "0xcontract_creation"


def topic(topics: Column, k: int) -> Column:
    """The k-th topic, from 1; null where there are fewer."""
    return F.try_element_at(topics, F.lit(k))


def classify_log(topics: Column) -> Column:
    """The activity of a log; null without topics."""
    t = F.lower(topic(topics, 1))
    kind = F.when(t == TRANSFER, "TRANSFER").when(t == SWAP, "SWAP").when(t == APPROVAL, "APPROVE").when(t == MINT, "MINT")
    return F.when(F.size(topics) >= 1, kind.otherwise("CONTRACT_EVENT"))


def address_of_topic(t: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(t, F.lit(40))))


def log_sender(topics: Column, contract: Column) -> Column:
    """Who an activity comes from."""
    kind = classify_log(topics)
    plain = F.when(F.size(topics) >= 3, address_of_topic(topic(topics, 2))).otherwise("")
    return F.when(kind == "MINT", ZERO_ADDRESS).when(kind == "CONTRACT_EVENT", F.lower(contract)).otherwise(plain)


def log_receiver(topics: Column) -> Column:
    """Who an activity goes to."""
    kind = classify_log(topics)
    plain = F.when(F.size(topics) >= 3, address_of_topic(topic(topics, 3))).otherwise("")
    minted = F.when(F.size(topics) >= 2, address_of_topic(topic(topics, 2))).otherwise("")
    return F.when(kind == "MINT", minted).when(kind == "CONTRACT_EVENT", "multiple").otherwise(plain)


def decode_uint256(data: Column) -> Column:
    """A log's whole data as one number (limbs), saturating beyond 256 bits."""
    return limbs_from_hex(F.coalesce(data, F.lit("")))


def uint256_text(data: Column) -> Column:
    """The same number as a decimal string."""
    return hex_to_text(F.coalesce(data, F.lit("")))


def abi_words(data: Column) -> Column:
    """The whole 32-byte words of a log's data, as hex."""
    n = F.floor((F.length(data) - 2) / 64).cast("int")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, 3 + 64 * i, F.lit(64)))).otherwise(F.array().cast("array<string>"))


def parse_numeric(text: Column) -> Column:
    """struct<value, error> of decimal, 0x or scientific notation; value is a canonical decimal string below 2^256."""
    t = F.trim(text)
    hexes = F.when(t.rlike("^0[xX][0-9a-fA-F]+$") & (F.length(F.regexp_replace(F.regexp_replace(t, "^0[xX]", ""), "^0+", "")) <= 64), hex_to_text(t))
    digits = F.regexp_replace(t, r"^\+", "")
    plain = F.when(digits.rlike("^[0-9]+$"), F.regexp_replace(digits, "^0+(?=.)", ""))
    mantissa, power = F.regexp_extract(t, r"^\+?([0-9]+(?:\.[0-9]*)?)[eE]", 1), F.regexp_extract(t, r"[eE]\+?([0-9]{1,3})$", 1)
    whole, fraction = F.regexp_extract(mantissa, r"^([0-9]+)", 1), F.regexp_replace(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1), "0+$", "")
    exponent = F.when(power == "", F.lit(-1)).otherwise(F.coalesce(power.try_cast("int"), F.lit(-1)))
    fits = (mantissa != "") & (exponent >= F.length(fraction)) & (exponent <= 100)
    scientific = F.when(fits, F.regexp_replace(F.concat(whole, fraction, F.repeat(F.lit("0"), F.greatest(exponent - F.length(fraction), F.lit(0)))), "^0+(?=.)", ""))
    value = F.when(t.rlike("^0[xX]"), hexes).when(t.rlike("[eE]"), scientific).otherwise(plain)
    limit = str((1 << 256) - 1)

    def judged(v: Column) -> Column:
        small = (F.length(v) < 78) | ((F.length(v) == 78) & (v <= limit))
        error = F.when(text.isNull() | (t == ""), "empty").when(v.isNull(), "not a whole number").when(~small, "overflow")
        return F.struct(F.when(small, v).alias("value"), error.alias("error"))

    return let(value, judged)


def normalize_sender(a: Column) -> Column:
    """Lower case; unknown senders get a pseudo-address."""
    return F.when(F.coalesce(a, F.lit("")) == "", UNKNOWN_SENDER).otherwise(F.lower(a))


def normalize_receiver(a: Column) -> Column:
    """Lower case; contract creations get a pseudo-address."""
    return F.when(a.isNull(), CREATION).otherwise(F.lower(a))


def short_symbol(a: Column) -> Column:
    return F.concat(F.substring(a, 1, 10), F.lit("..."))


def format_amount(amount: Column, decimals: Column) -> Column:
    """A decimal string divided by 10^decimals, four places, cut off; long integer parts are shortened."""
    digits = F.lpad(amount, F.greatest(F.length(amount), decimals + 1), F.lit("0"))
    whole = F.substring(digits, F.lit(1), F.length(digits) - decimals)
    places = F.rpad(F.substring(F.concat(F.right(digits, decimals), F.lit("0000")), 1, 4), 4, "0")
    shown = F.when(F.length(whole) > 12, F.concat(F.substring(whole, 1, 6), F.lit("..."), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.when(amount == "0", "0.0000").otherwise(F.concat(shown, F.lit("."), places))


def short_hash(value: Column, n: int, dots: bool = False) -> Column:
    """C16."""
    return F.concat(F.substring(value, 1, n), F.lit("...")) if dots else F.substring(value, 1, n)


def tag_flow(sender: Column, receiver: Column) -> Column:
    """What address prefixes tell about a transfer, compared in lower case."""
    out = None
    for side, prefix, tag in FLOW_PREFIXES:
        test = F.lower(sender if side == "from" else receiver).startswith(prefix)
        out = F.when(test, tag) if out is None else out.when(test, tag)
    return out.otherwise("User")


def flow_token(token: Column) -> Column:
    out = None
    for a, symbol in FLOW_TOKENS.items():
        out = F.when(F.lower(token) == a.lower(), symbol) if out is None else out.when(F.lower(token) == a.lower(), symbol)
    return out.otherwise("Unknown")


def visit_metadata(path: Column) -> Column:
    """The JSON that a visit is stored with."""
    return F.to_json(F.struct(path.alias("path"), F.lit("v1").alias("recorded_v")))


def safe_diff(a: Column, b: Column) -> Column:
    """C20: a - b of unsigned heights, saturating at the bounds of a long."""
    d = a.cast("decimal(20,0)") - b.cast("decimal(20,0)")
    return F.greatest(F.least(d, F.lit(str(2**63 - 1)).cast("decimal(21,0)")), F.lit(str(-(2**63))).cast("decimal(21,0)")).cast("long")


def epoch_latency(processed_at_ms: Column, timestamp: Column) -> Column:
    """Seconds between a block's time and its processing, 0 at least."""
    return F.greatest(processed_at_ms / 1000.0 - timestamp, F.lit(0.0))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """the client's address from a forwarding header or the peer, without port."""
    ip = F.when(F.coalesce(forwarded, F.lit("")) != "", forwarded).otherwise(remote)
    bracket, port = F.regexp_extract(ip, r"^\[([^\]]*)\]:[^:]*$", 1), F.regexp_extract(ip, r"^([^:,\[\]]*):[^:,]*$", 1)
    return F.when(ip.rlike(r"^\[[^\]]*\]:[^:]*$"), bracket).when(ip.rlike(r"^[^:,\[\]]*:[^:,]*$"), port).otherwise(F.trim(F.split(F.trim(ip), ",")[0]))


def is_visit(agent: Column, method: Column, ip: Column, admin: Column | None = None) -> Column:
    """a person's page view."""
    ok = agent.contains("Mozilla") & ~agent.rlike(BOTS) & (method == "GET") & (ip != "127.0.0.1")
    return ok if admin is None else ok & (admin.isNull() | (ip != admin))
