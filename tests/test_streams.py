from brightloom.plans import streams


def test_stream_sessions_are_those_of_the_whole_table(spark, sf):
    rows = lambda df: sorted(map(tuple, df.select("user_id", "session_start", "n").collect()), key=str)
    got = rows(streams.stream_sessions(spark, sf))
    assert got and got == rows(streams.user_sessions(spark, sf))
