"""An extension: windowed counts over an event stream. The rest of the library works on tables."""
