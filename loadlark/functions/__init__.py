"""Part of loadlark."""
