"""What the driver works out from literals before a plan is built."""
