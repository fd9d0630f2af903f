from plexora.operators import moments as M


def test_values_beyond_the_length_get_null():
    assert "MAX_LENGTH" in M.to_utc.__doc__
    value = "2025-01-01 10:00"
    fits = value + " " * (M.MAX_LENGTH - len(value))
    assert M.utc_texts(M.convert([fits, fits + " "], ["UTC"] * 2, [None] * 2)) == ["2025-01-01T10:00:00Z", None]
