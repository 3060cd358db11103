import pyarrow as pa

from calltide.operators import tokens


def test_a_value_of_several_batches_is_worked_out_once(monkeypatch):
    made, real = [], tokens.preserving_token
    monkeypatch.setattr(tokens, "preserving_token", lambda v, *a: made.append(v) or real(v, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(["+15550001111", None, "+15550001111", "ab-1"])], names=["number"])
    out = list(tokens._preserve(iter([batch, batch]), {"number": "token"}, b"key", False, ""))
    assert made == ["+15550001111", "ab-1"] and out[0].equals(out[1])
