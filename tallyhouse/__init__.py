"""DataFrame operators for monitored mentions, panels, registers and annotations."""
