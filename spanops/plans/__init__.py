"""Report packs: several operators over one base frame."""
