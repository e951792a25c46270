from talweg.cli import main

main()
