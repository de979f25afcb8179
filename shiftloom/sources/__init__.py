"""Where operators' inputs come from and where results go."""
