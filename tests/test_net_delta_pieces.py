from conftest import rows_of

from onledger.plans.signals import net_deltas


def test_moves_are_dealt_into_pieces_before_they_are_added_up(table):
    rows = table("tx long, token string, sender string, recipient string, amount long",
                 [(1, "t", "0x0", "a", 5), (1, "t", "a", "b", 2), (1, "t", "a", "b", 1), (2, "u", "b", "a", 7), (2, "u", None, "c", 1)])
    dealt = net_deltas(rows, ["tx", "token"], 7)
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "7), REPARTITION_BY_NUM" in text and text.rindex("HashAggregate") < text.index("Exchange")
    plain = net_deltas(rows, ["tx", "token"])
    assert rows_of(dealt, *dealt.columns) == rows_of(plain, *plain.columns)
