from __future__ import annotations

import base64
import ipaddress
import uuid

import pytest
from pyspark.sql import functions as F

from casewright.functions import ids, net, scalars, text
from casewright.operators import predicates as P

ADDRESSES = [
    "1.2.3.4", "01.2.3.4", "256.1.1.1", "::1", "::", "fe80::1", "2001:db8::1:0:0:1", "1:2:3:4:5:6:7:8", "1::2::3",
    "abc", "ff02::1", "1:0:0:2:0:0:0:3", "2606:4700::6810:84e5", "1:2:3", ":::", "::1.2.3.4", "10.1.2.3",
    "198.51.100.7", "0:0:1::", "100.64.0.1", "172.31.9.9", "172.32.0.1", "fd00::5",
]


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[1] for row in sorted(df.select("i", build(F.col("v"))).collect())]


def test_addresses_are_canonical_as_the_standard_library_says(spark):
    def expected(value):
        try:
            return ipaddress.ip_address(value).compressed
        except ValueError:
            return None

    assert column(spark, ADDRESSES, net.canonical_ip) == [expected(v) for v in ADDRESSES]


def test_external_means_outside_every_internal_network(spark):
    networks = [ipaddress.ip_network(n) for n in net.INTERNAL_NETWORKS]

    def expected(value):
        try:
            address = ipaddress.ip_address(value)
        except ValueError:
            return False
        return not any(address.version == n.version and address in n for n in networks)

    assert column(spark, ADDRESSES, net.is_external_ip) == [expected(v) for v in ADDRESSES]


def test_mapped_addresses_read_as_ipv4(spark):
    assert column(spark, ["::ffff:10.0.1.14", "-", " 10.0.0.1 ", "::ffff:0a00:010e"], net.as_ip) == [
        "10.0.1.14", None, "10.0.0.1", "10.0.1.14",
    ]


@pytest.mark.parametrize("cidr", ["10.0.0.0/8", "192.0.2.128/25", "2001:db8::/32", "fe80::/10"])
def test_network_membership(spark, cidr):
    values = ["10.9.9.9", "192.0.2.200", "192.0.2.1", "2001:db8::7", "2001:db9::7", "fe90::1", "x"]
    network = ipaddress.ip_network(cidr)

    def expected(value):
        try:
            return ipaddress.ip_address(value) in network
        except ValueError:
            return False

    assert column(spark, values, lambda v: net.in_network(v, cidr)) == [expected(v) for v in values]


def test_event_uid_is_a_version_5_uuid(spark):
    values = ["abc", "é", ""]
    assert column(spark, values, ids.event_uid) == [str(uuid.uuid5(ids.EVENT_NAMESPACE, v)) for v in values]


def test_event_times(spark):
    values = ["1700000000", "1700000000123", "2026-01-02T03:04:05.5+02:00", "2026-13-01T00:00:00Z", "true", "-5"]
    read = column(spark, values, lambda v: F.unix_millis(scalars.event_time(v)))
    assert read == [1700000000000, 1700000000123, 1767315845500, None, None, -5000]


def test_encoded_commands_decode_whatever_they_hold(spark):
    def encode(words):
        return base64.b64encode(words.encode("utf-16-le")).decode()

    broken = base64.b64encode(b"a\x00\x00\xd8b\x00c").decode()
    lines = [
        f"powershell -nop -e {encode('whoami é 😀')}",
        f"powershell /encodedcommand {encode('Reboot   initiated by Ansible')}",
        f"x -enc {broken}",
        f"x -file {encode('no')}",
    ]
    assert column(spark, lines, text.decoded_command) == ["whoami é 😀", "Reboot   initiated by Ansible", "ab", ""]
    assert column(spark, lines, text.is_harness_command) == [False, True, False, False]


def test_json_objects_are_found_in_answers(spark):
    answers = ['```json\n{"a":1}\n```', '<think>{x</think> so {"a":{}} done', "[1]", "none"]
    assert column(spark, answers, text.json_object_text) == ['{"a":1}', '{"a":{}}', None, None]


def test_mentions(spark):
    said = "to 1.2.3.4. and 1.2.3.4.5, 999.1.1.1, D41D8CD98F00B204E9800998ECF8427E"
    df = spark.createDataFrame([(said,)], "v string")
    assert df.select(text.mentions(F.col("v"))).first()[0] == ["1.2.3.4", "d41d8cd98f00b204e9800998ecf8427e"]


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([("8f?/", 123)], "uid string, t long")
    back = df.select(ids.decode_cursor(ids.encode_cursor(F.col("t"), F.col("uid")))["uid"], ids.decode_cursor(F.lit("!!")))
    assert tuple(back.first()) == ("8f?/", None)


@pytest.mark.parametrize(
    ("pattern", "value", "expected"),
    [
        ("*\\Net.exe", "C:\\a\\net.EXE", True),
        ("net*", "internet", False),
        ("a?c", "abc", True),
        ("a?c", "ac", False),
        ("*a*b*", "xxA\nyyBzz", True),
        ("100\\*", "100*", True),
        ("100\\*", "1000", False),
        ("a.c", "abc", False),
        ("", "", True),
    ],
)
def test_globs_match_whole_values(spark, pattern, value, expected):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(P.glob(pattern)(F.col("v"), T.StringType())).first()[0] is expected


def test_absent_fields_do_not_make_not_unknown(spark):
    from casewright.schema import conform

    df = conform(spark.createDataFrame([(1,), (None,)], "status_id int"))
    test = P.negate(P.field_match(("status_id",), P.equals(1)))
    assert sorted(r[0] for r in df.select(test).collect()) == [False, True]
