"""Column functions over texts and waveforms, and numbering of rows."""
